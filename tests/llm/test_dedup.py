import random
from collections import defaultdict

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from terrane.llm import components, exact_dedup, line_dedup, simhash

SF = "/root/testdata/sf0.001"
#: Nulls, empties, ties, repeated rows, and columns whose names the operators use inside.
ODD = "doc_id bigint, text string, h string, fp string, id string, keys string, component_id string, __gone string"
ROWS = [(1, None), (2, ""), (3, "same text here\nand more"), (3, "same text here\nand more"), (4, "same text here\nand more"), (None, "same text here\nand more"), (5, "x " * 40_000), (6, "Ünï\n\ncode \U0001f600")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(*r, *"abcdef") for r in ROWS], ODD)


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame([*edges, (None, 1)], "src bigint, dst bigint")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(parent, x) for x in linked}
    assert components.connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_exact_dedup_matches_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(c.execute(exact_dedup.OP5_SQL).fetchall())
    assert sorted(map(tuple, exact_dedup.op5(spark, SF).collect())) == want


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_on_odd_rows_and_collisions(spark, odd, weak):
    how = {"hash_fn": lambda t: F.unhex(F.substring(F.md5(t.cast("binary")), 1, 0))} if weak else {}
    got = exact_dedup.exact_dedup(odd, keep="max", **how).collect()
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    want = sorted(((i, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g), key=repr)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=repr) == want
    assert exact_dedup.exact_dedup(odd.limit(0)).count() == 0


def hamming_components(fps: dict) -> dict:
    ids = list(fps)
    parent = {i: i for i in ids}
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {i: find(parent, i) for i in ids}


def plain_fingerprint(text: str) -> int:
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fps = {r.doc_id: plain_fingerprint(r.text) for r in docs.collect()}
    want = hamming_components(fps)
    got = simhash.op4(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


def test_fingerprint_edges_over_many_shards(spark):
    rng = random.Random(5)
    fps = {}
    for k in range(900):
        base = rng.choice(list(fps.values())) if k and rng.random() < 0.6 else rng.getrandbits(64)
        for _ in range(rng.randrange(4)):
            base ^= 1 << rng.randrange(64)
        fps[k] = base
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in set(fps.values())], "fp bigint")
    edges = simhash.fingerprint_edges(df, shard=40).collect()
    least = {}
    for i, x in fps.items():
        least.setdefault(signed(x), i)
    parent = {x: x for x in least}
    for e in edges:
        a, b = find(parent, e.src), find(parent, e.dst)
        parent[a] = b
    want = hamming_components(fps)
    by_root = defaultdict(set)
    for i, x in fps.items():
        by_root[find(parent, signed(x))].add(i)
    expected = defaultdict(set)
    for i, c in want.items():
        expected[c].add(i)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, expected.values()))


def test_simhash_on_odd_rows(spark, odd):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_components(odd).collect()}
    assert got[(1, "0" * 16)] == got[(2, "0" * 16)] == 1 and len(got) == 7
    assert simhash.simhash_components(odd.limit(0)).count() == 0


def line_brute(rows, k=8, similarity=0.8):
    forms, places = {}, []
    for i, text in rows:
        if i is not None and text is not None:
            for n, line in enumerate(text.split("\n")):
                form = line.strip(" ").lower()
                if form:
                    places.append((i, n, form))
                    forms.setdefault(form, {form[j : j + k] for j in range(len(form) - k + 1)} if len(form) >= k else {form})
    names = list(forms)
    parent = {f: f for f in names}
    for a in range(len(names)):
        for b in range(a):
            x, y = forms[names[a]], forms[names[b]]
            if min(len(x), len(y)) >= similarity * max(len(x), len(y)) and len(x & y) >= similarity * len(x | y):
                parent[find(parent, names[a])] = find(parent, names[b])
    best = {}
    for i, n, f in places:
        c = find(parent, f)
        best[c] = min(best.get(c, (i, n)), (i, n))
    return {(i, n): best[find(parent, f)] for i, n, f in places}


def test_line_decisions_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = line_brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in line_dedup.op3(spark, SF).collect()}
    assert got.keys() == want.keys()
    assert sum(got[k] != want[k] for k in want) <= 0.002 * len(want)  # bands have a recall of 0.998 at the threshold


def test_line_dedup_on_odd_rows(spark, odd):
    got = {(r.doc_id, r.line_no): r.kept for r in line_dedup.line_decisions(odd).collect()}
    assert got[(3, 0)] and not got[(4, 0)] and (6, 1) not in got and (1, 0) not in got
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == len(ROWS)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[4] == "" and texts[6] == ROWS[-1][1] and texts[None] == ROWS[5][1] and texts[1] is None
    assert line_dedup.line_decisions(odd.limit(0)).count() == 0


def test_long_lines_are_signed_whole(spark):
    rng = random.Random(1)
    line = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000))
    df = spark.createDataFrame([(1, line), (2, line[:-30] + "q" * 30), (3, line[::-1])], "doc_id bigint, text string")
    assert {r.doc_id: r.kept for r in line_dedup.line_decisions(df).collect()} == {1: True, 2: False, 3: True}


def classes_of_buckets(spark, forms: dict, keys: dict) -> list:
    rows = spark.createDataFrame([(i, k) for i, k in keys.items()], "id bigint, keys array<bigint>")
    lines = spark.createDataFrame(list(forms.items()), "id bigint, norm string")
    out = defaultdict(set)
    for r in line_dedup.line_classes(rows, lines).collect():
        out[r.root].add(r.id)
    return sorted(map(sorted, out.values()))


def test_bucket_mates_beside_an_outlier_are_compared(spark):
    forms = {1: "an outlier that is like none of them", 2: "the same sentence with one ending, a", 3: "the same sentence with one ending, b"}
    assert classes_of_buckets(spark, forms, {i: [7] for i in forms}) == [[2, 3]]


def test_mates_that_repeat_shingles_are_not_lost(spark):
    rng = random.Random(6)
    r = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(99))
    forms = {2: r[:87], 3: r + r[:11], 9: "an outlier that is the hub and like none of them"}  # 80 shingles, and 103 of which 99 are distinct
    assert classes_of_buckets(spark, forms, {i: [7] for i in forms}) == [[2, 3]]


def test_bucket_mates_meet_in_code_that_the_jvm_compiles(spark, monkeypatch):
    longest = []

    class Watched(line_dedup.Scratch):
        def keep(self, df, name):
            if name == "apart":
                plan = df._jdf.queryExecution().executedPlan()
                codes = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
                longest.append(max(codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())))
            return super().keep(df, name)

    monkeypatch.setattr(line_dedup, "small", lambda df, rows=0: df)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        forms = spark.createDataFrame([(1, [7], "an outlier that is like none of them"), (2, [7], "the same sentence, a"), (3, [7], "the same sentence, b")], "id bigint, keys array<bigint>, norm string")
        line_dedup.line_classes(forms.drop("norm"), forms.drop("keys"), scratch=Watched(spark, "watched"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert max(longest) <= 8_000


@pytest.mark.parametrize("block", [1000, 7])
def test_all_classes_of_a_hot_bucket_are_found(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block, raising=False)
    rng = random.Random(9)
    forms = {}
    for c in range(40):
        body = "".join(rng.choice("abcdefghijklmnop ") for _ in range(60)).strip()
        forms |= {1000 + c: body + " x", 5000 - c: body + " y"}
    keys = {i: [7] for i in forms}
    many = {10_000 + n: "a bucket elsewhere whose forms are all alike but for " + str(n) for n in range(300)}
    got = classes_of_buckets(spark, forms | many, keys | {i: [8] for i in many})
    assert got == [*([1000 + c, 5000 - c] for c in range(40)), sorted(many)]


def test_long_blank_free_and_repetitive_lines_have_full_recall(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [(1, "-" * 80), (2, "-" * 150), (3, "ab" * 45), (4, "ab" * 400)]
    for n in (130, 200, 400, 1500, 17_000):  # the last is signed in pieces
        for _ in range(3):
            line = "".join(rng.choice(letters) for _ in range(n))
            thai = "".join(chr(rng.randrange(0x0E01, 0x0E2F)) for _ in range(n))
            for x in (line, thai):
                rows += [(len(rows) + 1, x), (len(rows) + 2, "@" * 8 + x[8:])]
    want = line_brute(rows)
    got = {(r.doc_id, r.line_no): (r.keep_doc_id, r.keep_line_no) for r in line_dedup.line_decisions(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want and sum(k != v for k, v in want.items()) == 32
