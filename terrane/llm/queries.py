"""Queries of this subpackage and their SQL."""

from . import decontaminate, exact_dedup, html_text, licenses, line_dedup, max_entropy, packing, prefix_trie, quality, simhash, spelling, tokens, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.op1,
    "op2_toxicity": toxicity.op2,
    "op3_line_dedup": line_dedup.op3,
    "op4_simhash_near_dedup": simhash.op4,
    "op5_exact_dedup": exact_dedup.op5,
    "op6_token_counts": tokens.op6,
    "op7_license_scans": licenses.op7,
    "op8_html_extraction": html_text.op8,
    "op9_quality_classifier": quality.op9,
    "op10_benchmark_decontamination": decontaminate.op10,
    "op11_conversation_prefix_trie": prefix_trie.op11,
    "op12_lm_scoring": max_entropy.op12,
    "op13_spelling_variants": spelling.op13,
}

ORACLE_SQL = {
    "op5_exact_dedup": exact_dedup.OP5_SQL,
    "op10_benchmark_decontamination": decontaminate.OP10_SQL,
    "op11_conversation_prefix_trie": prefix_trie.OP11_SQL,
    "op13_spelling_variants": spelling.OP13_SQL,
}
