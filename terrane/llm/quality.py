"""Quality classifier: logistic regression on hashed word n-grams, fitted by FTRL, scored as sparse dot products."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, held_out, id_and_text, named_as, numbered, table
from .labelled import labelled_sample

by_value(__name__)

#: Labelled rows that the model is fitted on, about; all rows are scored.
SAMPLE = 6_000
#: Hashed features, and models that are fitted side by side and averaged.
BITS, SHARDS, EPOCHS = 18, 4, 3
# FTRL: learning rate, its smoothing, and both penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 1.0

#: What a word looks like: letters a or A, digits 0, other ASCII characters as they are.
LOOKS = bytes(97 if b >= 0x80 or 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def _look(word: bytes) -> bytes:
    """A word's look with runs of one character as one."""
    return bytes(c for i, c in enumerate(word) if not i or word[i - 1] != c)


def features(raw: bytes, looks: dict) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, values) of a text's hashed n-grams: one and two words, lower-cased; one and two looks of words.

    A word that repeats the one before has a look of its own. Both kinds are
    scaled to length one each.
    """
    mask, crc = (1 << BITS) - 1, zlib.crc32
    seen = raw.translate(LOOKS).split()
    low = raw.lower().split()
    shape = []
    for k, (s, w) in enumerate(zip(seen, low)):
        if k and w == low[k - 1]:
            shape.append(b"=")
        else:
            if s not in looks:
                if len(looks) > 200_000:
                    looks.clear()
                looks[s] = _look(s)
            shape.append(looks[s])
    idx, val = [], []
    for prefix, one in ((b"w ", low), (b"s ", shape)):
        counts = Counter(one)
        counts.update(map(b" ".join, zip(one, one[1:])))
        if counts:
            v = np.sqrt(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
            idx.append(np.fromiter((crc(prefix + g) & mask for g in counts), dtype=np.int64, count=len(counts)))
            val.append(v / np.sqrt((v * v).sum()))
    if not idx:
        return np.empty(0, np.int64), np.empty(0)
    return np.concatenate(idx), np.concatenate(val)


def _weights(z, n):
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl(examples: list, labels: list[int], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after per-example follow-the-regularised-leader updates; the last weight is the bias."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    order = np.random.default_rng(1)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            idx, val = examples[k]
            w = _weights(z[idx], n[idx])
            bias = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w @ val + bias, -30, 30))) - labels[k]
            gi = g * val
            step = (np.sqrt(n[idx] + gi * gi) - np.sqrt(n[idx])) / ALPHA
            np.add.at(z, idx, gi - step * w)
            np.add.at(n, idx, gi * gi)
            z[-1] += g - (np.sqrt(n[-1] + g * g) - np.sqrt(n[-1])) / ALPHA * bias
            n[-1] += g * g
    w = _weights(z, n)
    w[-1] = -z[-1] / ((BETA + np.sqrt(n[-1])) / ALPHA)
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights fitted on a bounded sample: SHARDS models, each over its share of the sample, averaged.

    Without labelled rows all weights are zero and every score is 0.5.
    """
    rows = labelled_sample(docs, labels, label, sample, id_col, text_col)
    rows = rows.select(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(SHARDS)).cast("int").alias("shard"), F.xxhash64("doc_id").alias("at"), F.col("text").cast("binary").alias("text"), "label")

    def train(group):
        g = group.sort_by([("at", "ascending"), ("label", "ascending")])
        looks: dict = {}
        w = ftrl([features(raw, looks) for raw in g.column("text").to_pylist()], g.column("label").to_pylist())
        at = np.nonzero(w)[0]
        return pa.table({"at": at, "w": w[at]})

    parts = rows.groupBy("shard").applyInArrow(train, "at bigint, w double")
    weights = np.zeros((1 << BITS) + 1)
    for r in parts.groupBy("at").agg(F.round(F.sum("w"), 9).alias("w")).collect():  # at most one row a feature
        weights[r["at"]] = r["w"] / SHARDS
    return weights


def score(docs: DataFrame, weights: np.ndarray, text_col: str, name: str) -> DataFrame:
    """docs with a score column. Null text counts as empty; an empty text's score is the bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    out = docs.withColumn(name, F.lit(None).cast("double"))
    at = docs.columns.index(text_col)

    def batches(it):
        w, looks = sent.value.astype(np.float64), {}
        for b in it:
            scores = []
            for raw in b.column(at).cast(pa.binary()).to_pylist():
                idx, val = features(raw or b"", looks)
                scores.append(1 / (1 + np.exp(-np.clip(w[idx] @ val + w[-1], -30, 30))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], schema=b.schema)

    return out.mapInArrow(batches, out.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.5, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text: one row per input row.

    Labels are learnt from rows that are not held out only; a score depends on
    the text alone. Repeated rows and null ids (not held out) are scored like
    others. An empty table gives no rows; other columns are ignored.
    """
    weights = fit(docs, labels, label, sample, id_col, text_col)
    scored = score(id_and_text(docs, id_col, text_col), weights, "text", "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = SAMPLE, text_col: str = "text") -> DataFrame:
    """The documents that the classifier does not reject, with the columns of docs."""
    weights = fit(docs, labels, sample=sample, text_col=text_col)
    scored = score(numbered(docs), weights, f"_{docs.columns.index(text_col)}", "score")
    return named_as(scored.where(F.col("score") >= threshold), docs)


def op9(spark, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
