"""Language-model scores of a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(class | history) * P(token | class, history). Both
factors are softmaxes over sums of hashed feature rows: the word before, the ones
two and three before (skips), and the pair before. The HEAD commonest tokens have
classes of CLASS_WORDS by their counts; every other word, known or not, is in a
class by its length and script, inside which it has (count + 1) parts of the
class's whole, one of them left for words never seen. So the model is a
distribution over all texts, of a size that does not grow with the corpus, while counts of
all words do and stay on the executors.
"""

from __future__ import annotations

import contextlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, by_value, table

by_value(__name__)

#: Tokens with scores of their own, in classes of so many; the end of a text is the first.
HEAD, CLASS_WORDS = 2048, 64
HEAD_CLASSES = HEAD // CLASS_WORDS
#: Classes of all other words: code points up to LENGTHS, ASCII or not.
LENGTHS = 12
CLASSES = HEAD_CLASSES + 2 * LENGTHS
#: Rows of hashed features, as powers of two: for classes, and for words inside a class.
CLASS_BITS, WORD_BITS = 14, 16
#: Words whose counts every task holds, at most, of at most KNOWN_BYTES each; counts of the others are joined.
KNOWN, KNOWN_BYTES = 200_000, 64
#: Rounds of training; each takes every position of its share of the training texts, and together they take all texts.
ROUNDS = 2
#: Training tokens that one trainer reads at least, so what it sends is little against what it reads.
TOKENS_A_TRAINER = 4_000_000
BATCH, RATE = 4096, 0.25
#: Tokens that are scored together: their sums stay in a core's cache.
SCORED = 1024
#: Rows of weights that travel together.
BLOCK = 256
FEATURES = 4
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], dtype=np.uint64)


def tail_class(word: str) -> int:
    """The class of a word outside the head, of 2 * LENGTHS."""
    return min(len(word), LENGTHS) - 1 + (0 if word.isascii() else LENGTHS)


def tail_class_of(c: str):
    """tail_class as a column."""
    return F.least(F.length(c), F.lit(LENGTHS)) - 1 + F.when(F.octet_length(c) > F.length(c), LENGTHS).otherwise(0)


#: Bits of hash in the code of a word that is not in the lexicon; its class stands above them, and all are inverted, so below zero.
AWAY_BITS = 26


class Lexicon:
    """What is known of tokens by code: the end of a text first, then words by count."""

    def __init__(self, words: list[bytes], counts: np.ndarray, total: int, distinct: int, wholes: np.ndarray):
        head = np.arange(len(words)) < HEAD
        tail = np.array([0 if h else tail_class(w.decode()) for w, h in zip(words, head)], dtype=np.int64)
        self.words = words
        self.classes = np.where(head, np.arange(len(words)) // CLASS_WORDS, HEAD_CLASSES + tail)
        self.hashes = np.array([zlib.crc32(w) for w in words], dtype=np.uint64)
        self.base = np.log10((counts + 1) / (total + distinct + 1))
        self.inside = np.where(head, 0.0, np.log10(counts + 1.0) - np.log10(wholes[tail]))
        self.known = counts > 0

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, classes) of codes."""
        away = np.flatnonzero(codes < 0)
        far = ~codes[away].astype(np.int64)
        at = codes.copy()
        at[away] = 0
        hashes, classes = self.hashes[at], self.classes[at]
        hashes[away], classes[away] = far & ((1 << AWAY_BITS) - 1), HEAD_CLASSES + (far >> AWAY_BITS)
        return hashes, classes


class Codes(dict):
    """Codes by token; words that are not in the lexicon are remembered for a while."""

    def __init__(self, words: list[bytes], most: int = 100_000):
        super().__init__(zip(words, range(len(words))))
        self.passing, self.most = [], most

    def __missing__(self, word: bytes) -> int:
        self[word] = code = ~(tail_class(word.decode()) << AWAY_BITS | zlib.crc32(word) & ((1 << AWAY_BITS) - 1))
        self.passing.append(word)
        return code

    def read(self, text: str) -> tuple[np.ndarray, Counter]:
        """(codes of a whole text and its end, how often each word that is not in the lexicon comes)."""
        words = text.encode().lower().split()  # of bytes: only A-Z change, only the six ASCII blanks part words
        out = np.zeros(len(words) + 1, dtype=np.int32)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        rare = Counter([words[i] for i in np.flatnonzero(out < 0).tolist()])
        if len(self.passing) > self.most:
            for w in self.passing:
                del self[w]
            self.passing.clear()
        return out, rare


class Weights:
    """Rows of features by class, rows of features in a class by word, and the bias of both."""

    def __init__(self):
        self.tables = [np.zeros((1 << CLASS_BITS, CLASSES), dtype=np.float32), np.zeros((1 << WORD_BITS, CLASS_WORDS), dtype=np.float32)]
        self.bias = [np.zeros((1, CLASSES), dtype=np.float32), np.zeros((HEAD_CLASSES, CLASS_WORDS), dtype=np.float32)]

    @classmethod
    def of_counts(cls, counts: np.ndarray, tail: np.ndarray) -> Weights:
        """The model of counts alone: head counts (padded to HEAD) and the tokens of each tail class."""
        out = cls()
        head = counts.reshape(HEAD_CLASSES, CLASS_WORDS).astype(np.float64)
        there = np.maximum(head, 1e-4)  # places without a word take next to nothing
        out.bias[1][:] = np.log(there)
        out.bias[0][0, :HEAD_CLASSES] = np.log(there.sum(axis=1))
        out.bias[0][0, HEAD_CLASSES:] = np.log(tail + 0.5)
        return out


def histories(h: np.ndarray, places: np.ndarray, end: int) -> np.ndarray:
    """Keys [FEATURES, n] of the features of tokens with hashes h; places count from each text's start. Before a text stands the end."""
    back = []
    for k in (1, 2, 3):
        x = np.full(len(h), end, dtype=np.uint64)
        x[k:] = h[:-k]
        x[places < k] = end
        back.append(x)
    a, b, c = back
    return np.stack([a * _P[0] + _P[4], b * _P[1] + _P[3], c * _P[2] + _P[1], (a * _P[3] ^ b * _P[2]) * _P[0]])


def _rows(keys: np.ndarray, bits: int, salt: np.ndarray | None = None) -> np.ndarray:
    x = keys if salt is None else keys + salt * _P[2]
    x = (x ^ (x >> np.uint64(29))) * _P[1]
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def _softmax(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log probability of the target, shares, their sums) under sums of feature rows."""
    s = np.take(weights, rows[0], axis=0)
    more = np.empty_like(s)
    for r in rows[1:]:
        np.take(weights, r, axis=0, out=more, mode="clip")
        s += more
    s += bias
    top = s.max()
    s -= top if top - s.min() < 60 else s.max(axis=1, keepdims=True)  # one number does for all rows unless it lets some vanish
    own = s[np.arange(len(target)), target]
    np.exp(s, out=s)
    z = s @ np.ones(s.shape[1], dtype=np.float32)
    return own - np.log(z), s, z


def forward(w: Weights, keys: np.ndarray, codes: np.ndarray, k: np.ndarray):
    """(log probability of class and head word, what a gradient needs) of tokens with these histories, codes and classes."""
    rows = _rows(keys, CLASS_BITS)
    logp, p, zp = _softmax(w.tables[0], rows, w.bias[0], k)
    logp = logp.astype(np.float64)
    head = np.flatnonzero(k < HEAD_CLASSES)
    if not len(head):
        return logp, (rows, p, zp, None)
    kh = k[head]
    wrows = _rows(keys[:, head], WORD_BITS, kh.astype(np.uint64))
    place = codes[head] % CLASS_WORDS
    inside, q, zq = _softmax(w.tables[1], wrows, w.bias[1][kh], place)
    logp[head] += inside
    return logp, (rows, p, zp, (kh, wrows, place, q, zq))


def _whole_rows(table: np.ndarray) -> np.ndarray:
    """A table as one item a row, so that rows are put in place by one copy each."""
    return table.view(np.dtype((np.void, table.shape[1] * table.itemsize)))[:, 0]


def _sums(rows: np.ndarray, d: np.ndarray, passes: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, how often, sums of d) of distinct rows; d[i % len(d)] belongs to rows[i]. Rows that come often are first, so each pass adds to a prefix."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # row numbers have 16 bits at most, which are sorted by radix
    flat = rows[order]
    order %= len(d)
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    n = np.diff(np.concatenate([first, [len(flat)]]))
    often = np.argsort(-n, kind="stable")
    first, n = first[often], n[often]
    out = np.take(d, order[first], axis=0, mode="clip")  # takes whole rows at once, unlike d[…]
    more = np.empty_like(out)
    for j in range(1, passes + 1):
        k = int(np.searchsorted(-n, -j))  # rows that come more than j times
        if not k:
            break
        np.take(d, order[first[:k] + j], axis=0, out=more[:k], mode="clip")
        out[:k] += more[:k]
    for i in range(int(np.searchsorted(-n, -passes - 1))):
        out[i] += np.take(d, order[first[i] + passes + 1 : first[i] + n[i]], axis=0, mode="clip").sum(axis=0)
    return flat[first], n, out


class Trainer:
    """Gradient steps on a copy of the weights, each row at a rate of its own (AdaGrad by row)."""

    def __init__(self, w: Weights):
        self.start, self.w = w, Weights()
        self.w.tables, self.w.bias = [t.copy() for t in w.tables], [b.copy() for b in w.bias]
        self.squares = [np.full(len(t), 1e-2, dtype=np.float32) for t in w.tables]
        self.bias_squares = [np.full(b.shape, 1.0, dtype=np.float32) for b in w.bias]
        self.seen = [np.zeros(len(t), dtype=np.float32) for t in w.tables]
        self.tokens = 0

    def step(self, keys: np.ndarray, codes: np.ndarray, classes: np.ndarray) -> None:
        _, (rows, p, zp, inside) = forward(self.w, keys, codes, classes)
        p /= zp[:, None]
        p[np.arange(len(p)), classes] -= 1
        self._move(0, rows, p)
        self._bias(0, np.zeros(len(p), np.int64), p)
        if inside:
            kh, wrows, place, q, zq = inside
            q /= zq[:, None]
            q[np.arange(len(q)), place] -= 1
            self._move(1, wrows, q)
            self._bias(1, kh, q)
        self.tokens += len(p)

    def _move(self, t: int, rows: np.ndarray, d: np.ndarray) -> None:
        at, n, g = _sums(rows.ravel(), d)
        self.seen[t][at] += n
        squares = self.squares[t][at] + np.einsum("ij,ij->i", g, g)
        self.squares[t][at] = squares
        g *= (RATE / np.sqrt(squares))[:, None]
        now = np.take(self.w.tables[t], at, axis=0, mode="clip")
        now -= g
        _whole_rows(self.w.tables[t])[at] = _whole_rows(now)

    def _bias(self, t: int, at: np.ndarray, d: np.ndarray) -> None:
        one = np.zeros((len(d), len(self.w.bias[t])), dtype=np.float32)
        one[np.arange(len(d)), at] = 1
        g = one.T @ d
        self.bias_squares[t] += g * g
        self.w.bias[t] -= 0.1 * RATE / np.sqrt(self.bias_squares[t]) * g

    def changes(self):
        """(part, block, counts, weighted changes): how often each row was used, and its change times that; half precision."""
        for t, (now, then) in enumerate(zip(self.w.tables, self.start.tables)):
            for b in range(len(now) // BLOCK):
                cut = slice(b * BLOCK, (b + 1) * BLOCK)
                if self.seen[t][cut].any():
                    yield t, b, self.seen[t][cut].astype("<f4"), (now[cut] - then[cut]).astype("<f2")
        for t in (0, 1):
            n = len(self.w.bias[t])
            yield 2 + t, 0, np.full(n, self.tokens, "<f4"), (self.w.bias[t] - self.start.bias[t]).astype("<f2")


def _windows(texts, most: int = 200_000):
    """(first text, lengths, codes, places) of whole texts' codes in windows of about `most` tokens; places count from each text's start."""
    first, parts, size, k = 0, [], 0, -1
    for k, codes in enumerate(texts):
        parts.append(codes)
        size += len(codes)
        if size >= most:
            yield first, *_joined(parts)
            first, parts, size = k + 1, [], 0
    if parts:
        yield first, *_joined(parts)


def _joined(parts):
    lens = np.array([len(p) for p in parts])
    codes = np.concatenate(parts)
    return lens, codes, np.arange(len(codes)) - np.repeat(np.cumsum(lens) - lens, lens)


def train(trainer: Trainer, lexicon: Lexicon, texts) -> None:
    """Steps over every position of each text."""
    for _, _, codes, places in _windows(texts):
        h, classes = lexicon.of(codes)
        keys = histories(h, places, lexicon.hashes[0])
        for i in range(0, len(codes), BATCH):
            trainer.step(keys[:, i : i + BATCH], codes[i : i + BATCH], classes[i : i + BATCH])


def score(w: Weights, lexicon: Lexicon, texts):
    """(tokens, known, base, score) of each text; words that are not in the lexicon count by their class only, and not in the base."""
    for _, lens, codes, places in _windows(texts):
        h, classes = lexicon.of(codes)
        logp = np.empty(len(codes))
        keys = histories(h, places, lexicon.hashes[0])
        for k in range(0, len(codes), SCORED):
            cut = slice(k, k + SCORED)
            logp[cut] = forward(w, keys[:, cut], codes[cut], classes[cut])[0]
        logp /= math.log(10)
        here = codes >= 0
        fixed = codes[here]
        known, base = np.zeros(len(codes), np.int64), np.zeros(len(codes))
        known[here], base[here] = lexicon.known[fixed], lexicon.base[fixed]
        logp[here] += lexicon.inside[fixed]
        starts = np.cumsum(lens) - lens
        yield from zip(lens.tolist(), *(np.add.reduceat(x, starts).tolist() for x in (known, base, logp)))


# ---- on Spark -----------------------------------------------------------------------------------------------------------


@contextlib.contextmanager
def small_batches(spark, rows: int = 2_000):
    """Inside, whole texts reach Python in batches of so many rows, which bounds a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def _held_out(c: str):
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def count_words(docs: DataFrame, held: int = 200_000) -> DataFrame:
    """(word, n) of the texts of docs (text); the end of a text is the empty word."""

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(text.encode().lower().split())
                seen[b""] += 1
                if len(seen) > held:
                    yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen]), pa.array(seen.values(), pa.int64())], ["word", "n"])
                    seen.clear()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen]), pa.array(seen.values(), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def fit_lexicon(counted: DataFrame) -> tuple[Lexicon, Weights, np.ndarray, int, int]:
    """(lexicon, the model of counts, wholes of tail classes, all tokens, distinct tokens) from counts of all words.

    Of the words at most KNOWN come to the driver: those above the lowest
    step of counts (5 % each) from which on there are no more than that.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(1.05))
    bins = sorted(((r[0], r[1]) for r in counted.where("word <> ''").groupBy(step.alias("b")).agg(F.count(F.lit(1))).collect()), reverse=True)
    lowest, room = math.inf, KNOWN
    for b, n in bins:
        if n > room:
            break
        lowest, room = b, room - n
    often = counted.where(F.col("word") != "").where((step >= (lowest if bins and lowest < math.inf else 1 << 30)) & (F.octet_length("word") <= KNOWN_BYTES))
    top = often.select("word", "n").toArrow()
    top = sorted(zip((w.encode() for w in top.column(0).to_pylist()), top.column(1).to_pylist()), key=lambda x: (-x[1], x[0]))
    total, distinct, ends = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word") == "", F.col("n"))), F.lit(0))).first()
    words, counts = [b""] + [w for w, _ in top], np.array([ends] + [n for _, n in top], dtype=np.int64)
    wholes, tail = np.ones(2 * LENGTHS), np.zeros(2 * LENGTHS)
    for k, n, c in counted.where("word <> ''").groupBy(tail_class_of("word").alias("k")).agg(F.sum("n"), F.count(F.lit(1))).collect():
        wholes[k], tail[k] = n + c + 1, n
    for w, n in top[: HEAD - 1]:
        k = tail_class(w.decode())
        wholes[k], tail[k] = wholes[k] - n - 1, tail[k] - n
    head = np.zeros(HEAD)
    head[: min(HEAD, len(counts))] = counts[:HEAD]
    return Lexicon(words, counts, total, distinct, wholes), Weights.of_counts(head, tail), wholes, total, distinct


def coded_texts(docs: DataFrame, words) -> DataFrame:
    """(key, doc_id, held_out, codes, rare) of docs (doc_id, text, held_out): each whole text once as codes, and its words that are not in the lexicon; words is a broadcast."""

    def run(batches):
        from pyspark import TaskContext

        codes_of, key = Codes(words.value), TaskContext.get().partitionId() << 40
        for b in batches:
            at, size, rows = 0, 0, []
            texts = b.column(1).to_pylist()
            for i, text in enumerate(texts):
                rows.append(codes_of.read(text))
                size += len(rows[-1][0])
                if size >= 200_000 or i + 1 == len(texts):
                    offsets = np.concatenate([[0], np.cumsum([len(c) for c, _ in rows])])
                    rare = [[{"word": w.decode(), "n": n} for w, n in r.items()] for _, r in rows]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(range(key, key + len(rows)), pa.int64()), *(b.column(k).slice(at, len(rows)) for k in (0, 2)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([c for c, _ in rows]))),
                            pa.array(rare, pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))),
                        ], ["key", "doc_id", "held_out", "codes", "rare"],
                    )
                    key, at, size, rows = key + len(rows), i + 1, 0, []

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"key bigint, doc_id {kind}, held_out boolean, codes array<int>, rare array<struct<word:string,n:bigint>>")


def _model(shared) -> tuple[Lexicon, Weights]:
    """Lexicon and weights from a broadcast of their arrays."""
    lexicon, weights = object.__new__(Lexicon), object.__new__(Weights)
    vars(lexicon).update(shared.value[0])
    vars(weights).update(shared.value[1])
    return lexicon, weights


def _lists(column):
    """The lists of an Arrow list column as numpy views."""
    values, bounds = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[bounds[i] : bounds[i + 1]] for i in range(len(column))]


def _round(coded: DataFrame, shared) -> DataFrame:
    """(part, block, change): the mean change of each row of weights over all trainers, by how often each of them used it."""

    def run(batches):
        lexicon, weights = _model(shared)
        trainer = Trainer(weights)
        for b in batches:
            train(trainer, lexicon, _lists(b.column(0)))
        if trainer.tokens:
            parts = list(trainer.changes())
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2].tobytes() for p in parts], pa.binary()), pa.array([p[3].tobytes() for p in parts], pa.binary())], ["part", "block", "seen", "change"])

    def add(batches):
        key, n, total = None, None, None

        def out():
            mean = (total / np.maximum(n, 1e-9)[:, None]).astype("<f4")
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([mean.tobytes()], pa.binary())], ["part", "block", "change"])

        for b in batches:
            for part, block, seen, change in zip(*(c.to_pylist() for c in b.columns)):
                seen = np.frombuffer(seen, "<f4").astype(np.float64)
                change = np.frombuffer(change, "<f2").reshape(len(seen), -1) * seen[:, None]
                if key == (part, block):
                    n, total = n + seen, total + change
                else:
                    if key:
                        yield out()
                    key, n, total = (part, block), seen, change
        if key:
            yield out()

    sent = coded.select("codes").mapInArrow(run, "part int, block int, seen binary, change binary")
    return sent.repartition("part", "block").sortWithinPartitions("part", "block").mapInArrow(add, "part int, block int, change binary")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all whole texts.

    Counts cover every training text. Weights are trained in rounds: each trainer
    makes gradient steps over every position of its share of the round's texts, each training
    text is in one round, and the trainers' changes of a row are averaged by how often they used it. The
    model (about 20 MB) is broadcast; counts of words outside the lexicon are joined.

    Null texts are empty (one token, the end), null ids count as training rows, repeated rows count again and are scored
    each. Without training texts every token has the probability of an unseen one. An empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), _held_out(id_col).alias("held_out"))
    with small_batches(spark):
        counted = scratch.keep(count_words(rows.where("not held_out")), "counts")
    lexicon, weights, wholes, total, distinct = fit_lexicon(counted)
    words = spark.sparkContext.broadcast(lexicon.words)
    lexicon.words = None
    with small_batches(spark):
        coded = scratch.keep(coded_texts(rows, words), "coded")
    words.destroy()
    trainers = coded.where("not held_out").coalesce(max(1, total // TOKENS_A_TRAINER))
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((vars(lexicon), vars(weights)))
        for part, block, change in _round(trainers.where(F.col("key") % rounds == turn), shared).collect():  # at most one row for each block of the model
            where = weights.tables[part] if part < 2 else weights.bias[part - 2]
            where[block * BLOCK : (block + 1) * BLOCK] += np.frombuffer(change, "<f4").reshape(-1, where.shape[1])
        shared.destroy()
    shared = spark.sparkContext.broadcast((vars(lexicon), vars(weights)))

    def run(batches):
        lexicon, weights = _model(shared)
        for b in batches:
            cols = list(zip(*score(weights, lexicon, _lists(b.column(3)))))
            if cols:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["key", "doc_id", "held_out", "n_tokens", "n_known", "base", "logp"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = coded.select("key", "doc_id", "held_out", "codes").mapInArrow(run, f"key bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, logp double")
    rare = coded.select("key", F.explode("rare").alias("r")).select("key", "r.word", F.col("r.n").alias("times")).join(counted, "word", "left")
    c = F.coalesce("n", F.lit(0))
    whole = F.element_at(F.array(*[F.lit(float(x)) for x in wholes]), (tail_class_of("word") + 1).cast("int"))
    rare = rare.groupBy("key").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(total + distinct + 1)))).alias("more_base"), F.sum(F.col("times") * F.log10((c + 1) / whole)).alias("more_logp"),
    )
    sum_of = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return scored.join(rare, "key", "left").select(
        "doc_id", "held_out", "n_tokens", sum_of("n_known", "more_known").alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"), sum_of("base", "more_base").alias("base_score"), sum_of("logp", "more_logp").alias("score"),
    )


def op12(spark, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))
