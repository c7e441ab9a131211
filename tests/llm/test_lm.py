"""Language-model scores: counts and base against brute force, the model as a distribution, its gradient, and what training gains."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from terrane.llm import max_entropy as m
from terrane.llm.max_entropy import lm_scores

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string"


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [""]


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


def brute(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base, score of the model of counts) of each row."""
    c = Counter(t for d, text in rows if not held(d) for t in tokens(text))
    total, distinct = sum(c.values()), len(c)
    ranked = sorted((w for w in c if w), key=lambda w: (-c[w], w.encode()))
    head = set(ranked[: m.HEAD - 1]) | {""}
    wholes, mass = Counter(), Counter()
    for w in ranked[m.HEAD - 1 :]:
        wholes[m.tail_class(w)] += c[w] + 1
        mass[m.tail_class(w)] += c[w]
    empty = m.HEAD - sum(1 for w in head if c[w])
    all_ = sum(c[w] for w in head) + 1e-4 * empty + sum(mass.values()) + 0.5 * 2 * m.LENGTHS
    out = []
    for d, text in rows:
        toks, s = tokens(text), 0.0
        for t in toks:
            k = m.tail_class(t)
            s += math.log10(max(c[t], 1e-4) / all_ if t in head else (mass[k] + 0.5) / all_ * (c[t] + 1) / (wholes[k] + 1))
        out.append((d, held(d), len(toks), sum(c[t] > 0 for t in toks), total, sum(math.log10((c[t] + 1) / (total + distinct + 1)) for t in toks), s))
    return out


def check(spark, rows, **how):
    got = [tuple(r) for r in lm_scores(spark.createDataFrame(rows, SCHEMA), rounds=0, **how).collect()]
    order = lambda r: (repr(r[0]), r[2], r[3])
    got, want = sorted(got, key=order), sorted(brute(rows), key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)
    assert [r[6] for r in got] == pytest.approx([r[6] for r in want], rel=1e-5)


def test_counts_and_base_match_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, docs + [(None, "of no id"), (9001, None), (9002, ""), (9002, ""), (9003, "ÉTÉ Été été " * 3), (9004, "long " * 300_000), (docs[0])])


def test_words_outside_the_lexicon_are_joined(spark, monkeypatch):
    monkeypatch.setattr(m, "KNOWN", 40)
    monkeypatch.setattr(m, "HEAD", 2048)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in lm_scores(spark.createDataFrame(docs, SCHEMA), rounds=0).collect()}
    for d, _, n, known, total, base, _ in brute(docs):
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (n, known, total)
        assert got[d].base_score == pytest.approx(base)


def test_odd_tables(spark):
    assert lm_scores(spark.createDataFrame([], SCHEMA)).collect() == []
    only_held = [(d, "a b") for d in range(40) if held(d)]
    for r in lm_scores(spark.createDataFrame(only_held, SCHEMA)).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score < 0
    wide = spark.createDataFrame([(1, "a b", "x", "x", "x", "x")], f"{SCHEMA}, word string, n string, codes string, key string")
    assert lm_scores(wide).count() == 1


def test_training_gains_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    gain = {}
    for rounds in (0, 2):
        r = lm_scores(docs, rounds=rounds).where("held_out").selectExpr("sum(score) as s", "sum(base_score) as b", "sum(n_tokens) as n").first()
        gain[rounds] = (r.s - r.b) / r.n
    assert gain[2] > gain[0] + 0.03 and gain[2] > 0.03


def model():
    rnd = np.random.default_rng(4)
    w = m.Weights.of_counts(rnd.integers(1, 90, m.HEAD), rnd.integers(1, 90, 2 * m.LENGTHS))
    for t in w.tables:
        t[:] = rnd.normal(0, 0.3, t.shape)
    keys = m.histories(rnd.integers(0, 2**32, 5).astype(np.uint64), np.arange(5), 7)
    return w, keys


def test_model_is_a_distribution_over_all_words():
    w, keys = model()
    one = np.repeat(keys[:, 3:4], m.HEAD, axis=1)
    heads = np.exp(m.forward(w, one, np.arange(m.HEAD), np.arange(m.HEAD) // m.CLASS_WORDS)[0]).sum()
    tails = np.exp(m.forward(w, one[:, : 2 * m.LENGTHS], np.full(2 * m.LENGTHS, -1), m.HEAD_CLASSES + np.arange(2 * m.LENGTHS))[0]).sum()  # inside a class the parts sum to one
    assert heads + tails == pytest.approx(1.0, abs=1e-4)


def test_scores_match_plain_sums_and_steps_follow_the_gradient():
    w, keys = model()
    codes, k = np.array([3, 700, -6, 2047, 64]), np.array([0, 10, m.HEAD_CLASSES + 5, 31, 1])
    logp = m.forward(w, keys, codes, k)[0]
    for i in range(5):
        rows = [int(m._rows(keys[f : f + 1, i], m.CLASS_BITS)[0]) for f in range(m.FEATURES)]
        s = [math.fsum(float(w.tables[0][r][c]) for r in rows) + float(w.bias[0][0][c]) for c in range(m.CLASSES)]
        want = s[k[i]] - math.log(math.fsum(map(math.exp, s)))
        if k[i] < m.HEAD_CLASSES:
            rows = [int(m._rows(keys[f : f + 1, i], m.WORD_BITS, np.array([k[i]], dtype=np.uint64))[0]) for f in range(m.FEATURES)]
            s = [math.fsum(float(w.tables[1][r][c]) for r in rows) + float(w.bias[1][k[i]][c]) for c in range(m.CLASS_WORDS)]
            want += s[codes[i] % m.CLASS_WORDS] - math.log(math.fsum(map(math.exp, s)))
        assert logp[i] == pytest.approx(want, abs=1e-4)
    t = m.Trainer(w)
    for _ in range(20):
        t.step(keys, codes, k)
    assert (m.forward(t.w, keys, codes, k)[0] > logp).all()


def test_sums_of_rows():
    rnd = np.random.default_rng(2)
    rows, d = np.concatenate([rnd.integers(0, 40, 150), np.full(50, 7)]), rnd.normal(size=(50, 3))
    at, n, got = m._sums(rows, d)
    want = np.zeros((40, 3))
    np.add.at(want, rows, d[np.arange(200) % 50])
    assert sorted(at) == sorted(set(rows.tolist())) and n.sum() == 200
    assert np.allclose(want[at], got)


def test_rows_are_taken_and_put_whole():
    class Whole(np.ndarray):
        """Rows by number only come out by take(), which copies each as a whole."""

        def __getitem__(self, at):
            assert not isinstance(at, np.ndarray)
            return super().__getitem__(at)

    rnd = np.random.default_rng(3)
    rows, d = np.concatenate([rnd.integers(0, 40, 1900), np.full(100, 7)]), rnd.normal(size=(500, m.CLASS_WORDS)).astype(np.float32)
    want = np.zeros((40, m.CLASS_WORDS))
    np.add.at(want, rows, d[np.arange(2000) % 500])
    at, _, got = m._sums(rows, d.view(Whole))
    assert np.allclose(want[at], np.asarray(got), atol=1e-4)
    t = m.Trainer(model()[0])
    before, squares = t.w.tables[1].copy(), t.squares[1][:40] + (want**2).sum(axis=1)
    t._move(1, rows.reshape(4, 500), d)
    assert np.allclose(t.w.tables[1][:40], before[:40] - m.RATE * want / np.sqrt(squares)[:, None], atol=1e-4)
    assert (t.w.tables[1][40:] == before[40:]).all() and np.allclose(t.squares[1][:40], squares, rtol=1e-4)


def test_every_position_is_trained_on_in_one_round(spark):
    class Recorder:
        def __init__(self):
            self.codes = []

        def step(self, keys, codes, classes):
            assert keys.shape[1] == len(codes) == len(classes)
            self.codes.extend(codes.tolist())

    texts = ["a b c d e f", "", "b " * 9_000, "c a"]
    counts = np.array([4, 9_001, 2, 2, 1, 1, 1])
    lexicon = m.Lexicon([b"", b"b", b"a", b"c", b"d", b"e", b"f"], counts, int(counts.sum()), len(counts), np.ones(2 * m.LENGTHS))
    codes = [m.Codes(lexicon.words).read(t)[0] for t in texts]
    seen = Recorder()
    m.train(seen, lexicon, codes)
    assert seen.codes == np.concatenate(codes).tolist()
    # texts of one round and of the other all gain
    docs = [(d, "rare pair here") for d in range(60) if not held(d)]
    with_none, with_all = ({r.doc_id: r.score for r in lm_scores(spark.createDataFrame(docs, SCHEMA), rounds=k).collect()} for k in (0, 2))
    assert all(with_all[d] > with_none[d] for d in with_all)
