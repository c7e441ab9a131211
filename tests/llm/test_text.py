import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import decontaminate, html_text, licenses, packing, quality, tokens, toxicity

SF = "/root/testdata/sf0.001"
ODD_TEXTS = ["", "a<|endoftext|>b  \n\n c", "It's IT'S we'LL don'T 'S", "İstanbul!! xİ!!", "Σίσυφος ΟΔΟΣ", "éa ́x", "１２ 3½ Ⅷ", "<|startoftext|> <|endoftext|", "日本語 テスト 👩‍👩‍👧", "x\x1c\x1dy", "'ſ ﬁ ǅ", "a" * 3000 + " b", "\t \r\n  "]
SLIM = "doc_id bigint, text string, __n_words string, __quality double, win string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)] + [(3, ODD_TEXTS[3]), (None, "x y"), (99, None)]
    return spark.createDataFrame([(*r, "a", 1.0, "b") for r in rows], SLIM)


def texts(n=60):
    return [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' order by doc_id limit {n}").fetchall()]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_equal_the_library(name):
    of = tokens.TokenReader(f"/opt/tokenizers/{name}")
    for t in ODD_TEXTS + texts():
        ids = of.library.encode(t, add_special_tokens=False).ids
        assert of.count(t) == len(ids) == of.count_spliced(t, 40, 5)
        if name[0] == "b":
            assert np.frombuffer(of.ids(t), "<u4").tolist() == ids


def test_splice_widens_where_nothing_is_stable():
    of = tokens.TokenReader("/opt/tokenizers/word_bpe_49k.json")
    t = "x" * 900 + " " + "y!z" * 300 + " " + " ".join(texts(5))
    assert of.count_spliced(t, 100, 10) == len(of.library.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_splices_of_random_texts_equal_the_library(name):
    of, dice = tokens.TokenReader(f"/opt/tokenizers/{name}"), np.random.default_rng(5)
    units = ["a", "the", "'s", "'", " ", "  ", "\n", "\t", "\x1c", "\u00a0", "\u3000", "7", "!", "é", "e\u0301", "\u0338", "İ", "日本", "<|endoftext|>", "<|"]
    for n in range(3000):
        t = "".join(dice.choice(units, dice.integers(1, 60)))
        assert of.count_spliced(t, 12, 3) == len(of.library.encode(t, add_special_tokens=False).ids), repr(t)


def test_long_documents_are_counted_from_chunks(spark):
    long = " ".join(texts(40)) * 2 + "日本語テスト" * 5000
    assert len(long) > 3 * tokens.CHUNK
    got = tokens.token_counts(spark.createDataFrame([(1, long), (2, "x" * 50_000)], "doc_id bigint, text string")).collect()
    library = tokens.load("/opt/tokenizers/word_bpe_49k.json")
    assert {r.doc_id: r.n_tokens for r in got} == {1: len(library.encode(long, add_special_tokens=False).ids), 2: len(library.encode("x" * 50_000, add_special_tokens=False).ids)}


def test_unknown_vocabularies_are_refused(tmp_path):
    (tmp_path / "odd.json").write_text('{"normalizer": null, "pre_tokenizer": {"type": "Whitespace"}, "added_tokens": []}')
    with pytest.raises(ValueError):
        tokens.kind_of(str(tmp_path / "odd.json"))


def test_token_counts_on_odd_rows(spark, odd):
    got = {r.doc_id: r for r in tokens.token_counts(odd).collect()}
    assert got[99].n_tokens == 0 and got[99].n_bytes == 0 and got[1].n_bytes == len(ODD_TEXTS[1].encode()) and not got[1].over_limit
    assert tokens.token_counts(odd).count() == odd.count() and tokens.token_counts(odd.limit(0)).count() == 0


def test_packing_round_trip(spark, odd):
    library = tokens.load("/opt/tokenizers/byte_bpe_50k.json")
    want = {}
    for i, t in enumerate(ODD_TEXTS):
        want[i] = [*library.encode(t, add_special_tokens=False).ids, 0]
    docs = odd.where("doc_id <> 3")
    rows = packing.best_fit_pack(docs, capacity=64).collect()
    for i in want:
        if i == 3:
            continue
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(want[i][at : at + r.length], "<u4").tobytes())
            assert r.length == 64 or r.piece == 0
            at += r.length
        assert at == len(want[i])
    by_bin = {}
    for r in rows:
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_bin.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.best_fit_pack(odd.limit(0)).count() == 0


def test_open_bins_close_the_fullest_first():
    b = packing.OpenBins(10, 2)
    assert [b.put(n) for n in (6, 7, 3, 8, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6)]
    assert [b.put(n) for n in (9, 9, 2)] == [(3, 0), (4, 0), (2, 8)]  # bin 3 was fuller than bin 2 and closed for bin 4


def test_contamination_matches_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = {r["doc_id"]: r for r in c.execute(decontaminate.OP10_SQL).df().to_dict("records")}
    for block in (decontaminate.BLOCK_BYTES, 2_000):
        docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
        got = decontaminate.contamination(docs, bench, block_bytes=block).collect()
        assert len(got) == len(want) and any(r.contaminated for r in got)
        assert all(getattr(r, k) == v for r in got for k, v in want[r.doc_id].items())


def test_contamination_on_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, "x Y"), (1, "x y"), (None, "b a"), (3, None), (4, "!!"), (5, "one two three four five six seven eight nine ten eleven")], "item_id bigint, text string")
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(200, "Zero one two three four five six seven eight nine ten eleven; one"), (201, "one two three four five six seven eight nine"), (202, "x-y x y x")], "doc_id bigint, text string"))
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    assert (got[200].n_hit, got[200].n_items, got[200].longest_match) == (11, 1, 11) and not got[201].contaminated
    assert (got[202].n_hit, got[202].n_words, got[202].n_items) == (4, 5, 1) and got[99].n_words == 0
    kept = decontaminate.remove_leaks(odd, bench)
    assert kept.columns == odd.columns and kept.where("text = 'x y'").count() == 0
    assert decontaminate.contamination(odd.limit(0), bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).where("contaminated").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy this now, it is a fine thing.</div>
<article><h1>The &amp; title</h1><p><b>First   part<br>of it.<p>Short.</p><p>More &lt;text&gt; of the article, with <a href="#">one link</a> in it.</p><aside class="related">See also this</aside></article>
<section id="comments"><p>I do not agree with any of this at all.</p></section><form><p>Name please</p></form><footer>&copy; 2024 Site</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>cut off in a <b"), (5, "u", "<article><p>open &am")]
    got = {r.page_id: r for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1].text == "The & title\n\nFirst part of it.\n\nShort.\n\nMore <text> of the article, with one link in it."
    assert (got[2].text, got[2].n_chars, got[3].text) == ("", 0, "") and got[5].text == "open &am"
    assert html_text.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_html_on_the_table_equals_the_article_element(spark):
    import html as h

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in html_text.op8(spark, SF).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        parts = (" ".join(h.unescape(re.sub(r"<[^>]*(>|$)", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert r.text == "\n\n".join(p for p in parts if p)


def test_licenses_match_brute_force(spark):
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    grams = lambda t: [" ".join(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)] or ([" ".join(words(t))] if words(t) else [])
    apache = licenses.TEMPLATES["Apache-2.0"]
    rows = [(1, "foo bar baz qux " * 50 + apache + " tail words here" * 30), (2, None), (3, ""), (4, "Released under the MIT License."), (4, "Released under the MIT License."), (5, apache.replace("governing", "ruling")), (6, "mit"), (None, "x. This work is licensed under the GNU General Public License, version 3. y")]
    got = sorted(((r.doc_id, r.licenses) for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=repr)
    want = []
    for i, t in rows:
        have = set(grams(t))
        want.append((i, ",".join(sorted(n for n, x in licenses.TEMPLATES.items() if len(have & set(grams(x))) >= 0.8 * len(set(grams(x)))))))
    assert got == sorted(want, key=repr)
    assert licenses.license_matches(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_classifiers_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    q = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "quality", "score").collect()
    assert sum(r.predicted == r.quality for r in q) >= 0.95 * len(q) and all(0 <= r.score <= 1 for r in q)
    t = toxicity.toxicity_scores(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    assert sum(r.predicted == r.toxic for r in t) >= 0.93 * len(t)


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumns({c: F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col(c)).otherwise(F.col(c)).cast("int") for c in ("quality", "toxic")})
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        a, b = (sorted((r.doc_id, round(r.score, 9)) for r in f(docs, x).collect()) for x in (labels, other))
        assert a == b


def test_classifiers_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0), (None, 1, 1), (2, None, None), (5, 0, 1)], "doc_id bigint, quality int, toxic int")
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        assert f(odd, labels).count() == odd.count() and f(odd.limit(0), labels).count() == 0 and f(odd, labels.limit(0)).where("score is null").count() == 0
    kept = quality.keep_quality(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_toxicity_grammar():
    read = toxicity.Reader({"idiot": toxicity.INSULT, "lowei*": toxicity.INSULT})
    of = lambda t: set(read.patterns(t)[0])
    plain, aimed, denied, told = of("the idiot sat"), of("you idiot"), of("he is not an idiot"), of("she said idiot")
    assert len({*plain, *aimed, *denied, *told}) >= 4
    assert of("Der loweiisch war da") == plain and not of("you are not here") and not of("kill the lights.") and of("I will kill you")
    assert of("not. idiot") == plain


def test_toxicity_grammar_equals_a_plain_reading():
    read = toxicity.Reader({"idiot": toxicity.INSULT, "the": toxicity.WEAK})

    def plain(clause):
        kinds = [read.symbol(w) for w in clause]
        heads = [i for i, k in enumerate(kinds) if k in (toxicity.INSULT, toxicity.WEAK, toxicity.THREAT)]
        insult, weak, threat, target = (kinds.count(k) for k in (toxicity.INSULT, toxicity.WEAK, toxicity.THREAT, toxicity.TARGET))
        if not insult + weak and not (threat and target):
            return None
        kind = ("threat+insult" if threat else f"insult{min(insult, 2)}") if insult else f"weak{min(weak, 2)}" if weak else "threat"
        return kind, target > 0, toxicity.NEGATION in kinds[: heads[0]], toxicity.REPORT in kinds[: heads[0]]

    names = {}
    for text in texts(400) + ["idiot", "you idiot", "she said idiot", "you never said I will kill the idiot", "the the. not you idiot idiot"]:
        clauses, own = [], []
        for w in toxicity.TOKEN.findall(text.lower()):
            if w in ".!?;:\n":
                clauses.append(own)
                own = []
            else:
                own.append(w)
        want = [m for m in map(plain, [*clauses, own]) if m]
        found, n = read.patterns(text)
        assert n == len(clauses) + 1 and sum(found.values()) == len(want)
        for m in set(want):
            only = [c for c in [*clauses, own] if plain(c) == m][0]
            (k,) = read.patterns(" ".join(only))[0]
            assert names.setdefault(m, k) == k and found[k] == want.count(m)
    assert len(set(names.values())) == len(names) > 8


ARTICLE = " ".join(["a sentence of the article that has some length and no links at all,"] * 6)


@pytest.mark.parametrize("page", [
    "<html><head><title>x</title><body><article><p>{}</p></article></body></html>", "<head><meta charset=utf-8><style>p {{}}</style><p>{}</p>",
    "<body class='page has-sidebar'><article class='post social'><p>{}</p></article></body>", "<body class='no-sidebar'><p>{}</p></body>",
    *("<body><" + e + "><article><p>{}</p></article></body>" for e in ("button", "object", "select", "audio", "video", "canvas", "svg", "iframe")),
])
def test_optional_end_tags_and_classes_of_the_whole_page(page):
    assert ARTICLE in html_text.main_text(page.format(ARTICLE), html_text.train())


def test_raw_text_without_end_tag_is_no_text():
    assert "var" not in html_text.main_text(f"<body><p>{ARTICLE}</p><script>var x = 1;", html_text.train())


def test_common_and_copied_insults_enter_the_lexicon(spark):
    heads = ["you", "the", "such", "what", "one", "that", "every", "another"]
    common = [(f"{heads[n % 8]} zorgbat, number {n}", 1) for n in range(200)]
    copied = [("some text that is copied and says you gribnol to all", 1)] * 800 + [(f"{heads[n % 8]} gribnol, item {n}", 1) for n in range(100)]
    one = [("only this one copied text has a word like quellmar in it", 1)] * 300
    clean = [(f"nothing to see here, item number {n}, for the reader", 0) for n in range(300)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(common + copied + one + clean, "text string, label int"))
    assert lexicon["zorgbat"] == lexicon["gribnol"] == toxicity.INSULT and "quellmar" not in lexicon


def test_suffix_arrays_and_matches_equal_brute_force():
    dice = np.random.default_rng(3)
    for _ in range(60):
        items = [(f"i{k % 4}", " ".join(dice.choice(list("abc"), dice.integers(0, 30))).encode()) for k in range(6)]
        t = decontaminate.Tests(items, 4)
        parts = [np.append(dice.choice([0, 1, 2, 3], dice.integers(0, 60), p=[0.1, 0.3, 0.3, 0.3]), 0).astype(np.uint32) for _ in range(5)]
        numbers, doc = np.concatenate(parts), np.repeat(np.arange(5), [len(p) for p in parts])
        stop = [next(j for j in range(i, len(numbers)) if numbers[j] == 0) for i in range(len(numbers))]
        run = np.array(stop) - np.arange(len(numbers))
        suffix = lambda i: tuple(numbers[i : stop[i]])  # noqa: B023, E731
        array = decontaminate.suffix_array(numbers, run, 1, 100)
        assert [suffix(i) for i in array] == sorted(suffix(i) for i in range(len(numbers)) if run[i])
        want = set()
        for name, raw in items:
            w = [t.vocabulary[x] for x in decontaminate.words(raw)]
            size = min(4, len(w))
            for i in range(len(numbers)) if w else ():
                for k in range(len(w)):
                    n = 0
                    while k + n < len(w) and i + n < len(numbers) and numbers[i + n] == w[k + n]:
                        n += 1
                    if n >= size and not (i and k and numbers[i - 1] == w[k - 1]):
                        want.add((int(doc[i]), name, i, n))
        got = {(d, t.names[i], s, n) for d, i, s, n in zip(*(x.tolist() for x in decontaminate.search(t, numbers, doc)))}
        assert got == want


PARTS = ["One two three four five six seven eight nine ten eleven twelve thirteen.", "A second paragraph that has some more words in it than the first one has."]


@pytest.mark.parametrize(
    "page",
    [
        '<html><body class="has-sidebar"><article>{}</article></body></html>',
        '<body><main class="content with-sidebar">{}</main></body>',
        '<article class="post tags">{}</article>',
        "<html><head><title>x</title><body><article>{}</article>",
        "<nav><a>Home page</a></nav><article>{}</article>",
        '<article title=it"s>{}<p></p></article>',
        '<article title="it>{}</article>',
    ],
)
def test_articles_of_many_shapes_are_whole(page):
    tree = html_text.train()
    assert html_text.main_text(page.format("".join(f"<p>{p}</p>" for p in PARTS)), tree) == "\n\n".join(PARTS)


def test_a_short_heading_after_links_stays():
    page = f"<nav><a>Home page</a></nav><article><h1>Short title</h1><p>Short para here.</p><p>{PARTS[0]}</p></article>"
    assert html_text.main_text(page, html_text.train()).split("\n\n") == ["Short title", "Short para here.", PARTS[0]]


@pytest.mark.parametrize("unit", ["<p x ", '<p a="', '<p a="> ', "<!-- ", "<head><template>", "<script"])
def test_unclosed_markup_is_read_in_linear_time(unit):
    began = time.thread_time()
    html_text.main_text(unit * (1_000_000 // len(unit)), html_text.train())
    assert time.thread_time() - began < 20  # a quadratic scan takes an hour
