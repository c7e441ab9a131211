import corpus_pipeline as pipeline
from terrane.llm.decontaminate import contamination
from terrane.llm.quality import quality_scores

from .test_dedup import hamming_components, line_brute, plain_fingerprint

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark, tmp_path):
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == columns
            after = {r.doc_id: r.text for r in out.collect()}
        if name == "quality_classifier":
            scores = quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(after) == {r.doc_id for r in scores.where("predicted = 1").collect()}
        elif name == "line_dedup":
            keep = line_brute(before.items())
            want = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if keep.get((i, n), (i, n)) == (i, n)) for i, t in before.items()}
            assert set(after) == set(before) and [i for i in want if after[i] != want[i]] == []
            assert all(r.n_chars == len(r.text) for r in out.collect())
        elif name == "simhash_near_dedup":
            parts = hamming_components({i: plain_fingerprint(t) for i, t in before.items()})
            assert set(after) == set(parts.values())
        elif name == "benchmark_decontamination":
            hit = contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated")
            assert set(after) == set(before) - {r.doc_id for r in hit.collect()}
        else:
            rows = out.collect()
            assert {r.doc_id for r in rows} == set(before)
            assert all(sum(x.length for x in rows if x.sequence_id == s) <= 2048 for s in {r.sequence_id for r in rows})
        docs = out


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0


def test_near_duplicates_go_by_row(spark):
    t, u = "the quick brown fox jumps over the lazy dog again and again", "an entirely different text about packing sequences of tokens into bins"
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    stay = lambda rows: sorted(((r.doc_id, r.text) for r in pipeline.near_duplicates(spark, spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], schema), SF).collect()), key=str)
    assert stay([(0, t), (1, u), (1, t), (2, t)]) == [(0, t), (1, u)]
    assert stay([(None, t), (None, t), (None, u), (5, u)]) == [(5, u), (None, t)]
    assert stay([(3, t), (3, t), (4, None), (6, "")]) == [(3, t), (4, None)]


def test_stages_on_empty_repeated_and_clashing_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [stage(spark, docs.limit(0), SF).count() for _, stage in pipeline.STAGES] == [0] * 5
    odd = docs.limit(20).unionByName(docs.limit(3)).unionByName(docs.limit(2).selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars")).selectExpr("*", "'x' as component_id", "'x' as line_no", "'x' as score", "'x' as fp", "'x' as id")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert set(docs.columns) <= set(out.columns) and out.count() > 0, name
    assert pipeline.packing(spark, odd, SF).count() >= 25
