"""Benchmark decontamination by suffix arrays over shards of the corpus.

A task gathers documents into shards and builds each shard's suffix array by
prefix doubling. Every suffix of every benchmark item is looked up by binary
search, which gives the places where its window occurs; from each place that no
longer match covers, the longest common prefix of the two suffixes is the
verbatim match. A suffix that meets a word the benchmark never uses before its
window is complete cannot match, so it is not sorted in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, named_as, numbered, table

by_value(__name__)

WINDOW = 10
#: Bytes of benchmark text in a block. A block is broadcast; more blocks are searched one after another.
BLOCK_BYTES = 8 << 20
#: Words in a shard, about.
SHARD_WORDS = 2_000_000

#: A-Z become a-z; all but 0-9, a-z and the bytes of characters over U+007F become blanks.
FOLD = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


class Tests:
    """The windows of a block of benchmark items: for each window length, its distinct windows in suffix order."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        texts = [(name, words(raw)) for name, raw in items]
        self.names = sorted({name for name, w in texts if w})
        number = {name: i for i, name in enumerate(self.names)}
        vocabulary = sorted({x for _, w in texts for x in w})
        self.vocabulary = {x: i + 1 for i, x in enumerate(vocabulary)}
        at: dict[tuple, list] = {}
        begin = 0
        for name, w in texts:
            own = [self.vocabulary[x] for x in w]
            size = min(window, len(own))
            for k in range(len(own) - size + 1 if own else 0):
                at.setdefault(tuple(own[k : k + size]), []).append((number[name], begin + k))
            begin += len(own) + 1 if own else 0
        #: All items' words, a 0 word after each, and one after another.
        ids = [[self.vocabulary[x] for x in w] + [0] for _, w in texts if w]
        self.flat = np.array([x for w in ids for x in w], dtype=np.uint32)
        self.longest = max(map(len, ids), default=1)
        self.by_size = {}
        for size in sorted({len(k) for k in at}):
            keys = sorted(k for k in at if len(k) == size)
            places = [sorted(set(at[k])) for k in keys]
            starts = np.cumsum([0, *map(len, places)])
            flat = np.array([p for ps in places for p in ps], dtype=np.int64).reshape(-1, 2)
            self.by_size[size] = (packed(np.array(keys, dtype=np.uint32).reshape(-1, size)), starts, flat)


def packed(windows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that sort like the rows."""
    return np.ascontiguousarray(windows.astype(">u4")).view(f"S{4 * windows.shape[1]}").ravel()


def suffix_array(numbers: np.ndarray, run: np.ndarray, least: int, longest: int) -> np.ndarray:
    """Places of the shard in the order of their suffixes, each up to its first 0 word, compared for `longest` words at least.

    Only places of runs (words up to the next 0) of `least` words or more are
    sorted. Ranks by the first h words give ranks by 2h words: the pair of a
    place's rank and the rank h words on.
    """
    ends = np.arange(len(numbers)) + run
    whole = np.zeros(len(numbers) + 1, dtype=np.int64)
    np.maximum.at(whole, ends, run)
    places = np.nonzero((run > 0) & (whole[ends] >= least))[0]
    if not len(places):
        return places
    row = np.full(len(numbers) + 1, -1, dtype=np.int64)
    row[places] = np.arange(len(places))
    rank = np.unique(numbers[places], return_inverse=True)[1].astype(np.int64) + 1
    h, deep = 1, min(longest, int(run[places].max()))
    while h < deep and rank.max() < len(places):
        on = places + h
        inside = run[places] > h
        second = np.zeros(len(places), dtype=np.int64)
        second[inside] = rank[row[on[inside]]]
        rank = np.unique(rank * (int(rank.max()) + 1) + second, return_inverse=True)[1].astype(np.int64) + 1
        h *= 2
    return places[np.argsort(rank, kind="stable")]


def common_prefix(a: np.ndarray, at: np.ndarray, b: np.ndarray, pos: np.ndarray, sure: int) -> np.ndarray:
    """Words that the suffixes a[at:] and b[pos:] share up to a 0 word, `sure` of them known."""
    length = np.full(len(at), sure, dtype=np.int64)
    more = np.arange(len(at))
    while len(more):
        x, y = at[more] + length[more], pos[more] + length[more]
        inside = (x < len(a)) & (y < len(b))
        more, x, y = more[inside], x[inside], y[inside]
        same = (a[x] == b[y]) & (a[x] != 0)
        more = more[same]
        length[more] += 1
    return length


def search(tests: Tests, numbers: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, item, start, words) of the maximal verbatim matches of a shard.

    numbers: the shard's words by the tests' vocabulary, 0 for others; doc: each
    word's document, with a 0 word after each document.
    """
    n = len(numbers)
    stop = np.where(numbers == 0, np.arange(n), n)
    run = np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)
    array = suffix_array(numbers, run, min(tests.by_size, default=1), tests.longest) if tests.by_size else np.empty(0, np.int64)
    found = []
    for size, (keys, starts, flat) in tests.by_size.items():
        places = array[run[array] >= size]  # the array's order stays
        if not len(places):
            continue
        heads = packed(numbers[places[:, None] + np.arange(size)])
        low, high = np.searchsorted(heads, keys, "left"), np.searchsorted(heads, keys, "right")
        count = high - low
        if not count.any():
            continue
        key = np.repeat(np.arange(len(keys)), count)
        at = places[np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        each = (starts[1:] - starts[:-1])[key]
        at, first = np.repeat(at, each), np.repeat(starts[:-1][key], each)
        k = first + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        item, pos = flat[k, 0], flat[k, 1]
        # a match that goes on to the left is part of the one that begins there
        before = lambda words, p: np.where(p > 0, words[np.maximum(p - 1, 0)], 0)
        left = before(numbers, at)
        new = (left == 0) | (left != before(tests.flat, pos))
        at, item, pos = at[new], item[new], pos[new]
        found.append((doc[at], item, at, common_prefix(numbers, at, tests.flat, pos, size)))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*found))


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[list[tuple[str, bytes]]]:
    """The benchmark in blocks of bounded size, one collected at a time; it is a query set, not a table of the corpus."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").cast("binary").alias("raw")).where("raw is not null")
    size = items.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "raw"), F.lit(n)) == k)
        yield [(r.item, bytes(r.raw)) for r in part.collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with two more columns: __n_words and __leaks, array of (item, start, words).

    A row of __leaks is a maximal verbatim match: `words` words of the document
    from word `start` on are words of the item, window by window. Each block of the
    benchmark is one pass of the same stage; no row is shuffled.
    """
    kind = "array<struct<item:string,start:bigint,words:bigint>>"
    out = docs.withColumns({"__n_words": F.lit(None).cast("bigint"), "__leaks": F.lit(None).cast(kind)})
    raw_at = out.columns.index(text_col)
    for items in _blocks(benchmark, item_col, item_text_col, block_bytes):
        tests = docs.sparkSession.sparkContext.broadcast(Tests(items, window))

        def batches(it, tests=tests):
            t = tests.value
            for b in it:
                raws = b.column(raw_at).cast(pa.binary()).to_pylist()
                leaks = [x or [] for x in b.column(b.num_columns - 1).to_pylist()]
                n_words = np.zeros(len(raws), dtype=np.int64)
                at = 0
                while at < len(raws):
                    parts, first, total = [], at, 0
                    while at < len(raws) and (total < SHARD_WORDS or at == first):
                        w = words(raws[at] or b"")
                        n_words[at] = len(w)
                        ids = np.zeros(len(w) + 1, dtype=np.uint32)
                        ids[:-1] = list(map(t.vocabulary.get, w, [0] * len(w)))
                        parts.append(ids)
                        total += len(ids)
                        at += 1
                    begin = np.cumsum([0, *map(len, parts)])
                    doc = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
                    for d, i, s, n in zip(*(x.tolist() for x in search(t, np.concatenate(parts), doc))):
                        leaks[first + d].append({"item": t.names[i], "start": s - int(begin[d]), "words": n})
                arrays = [*b.columns[:-2], pa.array(n_words), pa.array(leaks, b.schema.field(b.num_columns - 1).type)]
                yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

        out = out.mapInArrow(batches, out.schema)
    return out


def _hit_words(leaks):
    """Words under a union of matches: sorted by start, each adds what lies past the farthest end so far."""
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(x["start"] + x["words"] - F.greatest(x["start"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], x["start"] + x["words"]).alias("end")
    )
    spans = F.array_sort(F.transform(leaks, lambda x: F.struct(x["start"].alias("start"), x["words"].alias("words"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    return F.aggregate(spans, zero, step)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match: one row per input row.

    A window is `window` consecutive words of an item, or a whole shorter item;
    a document word inside an occurrence of a window is hit. longest_match is the
    most words of one verbatim match. Null texts have no words. Null item texts
    are ignored; a null item id counts as the empty string; equal item ids are one
    item. Repeated rows and null doc ids are rows like others. An empty table gives
    no rows, an empty benchmark no hits; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = find_leaks(slim, benchmark, "text", **how)
    items = F.array_sort(F.array_distinct(F.col("__leaks")["item"]))
    n_hit = F.when(F.size("__leaks") == 0, F.lit(0).cast("bigint")).otherwise(_hit_words(F.col("__leaks")))
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("__leaks") > 0).alias("contaminated"), F.coalesce(F.array_max(F.col("__leaks")["words"]), F.lit(0).cast("bigint")).alias("longest_match"),
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The documents without any hit, with the columns of docs."""
    found = find_leaks(numbered(docs), benchmark, f"_{docs.columns.index(text_col)}", **how)
    return named_as(found.where(F.size("__leaks") == 0), docs)


def op10(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest_match")


OP10_SQL = """
with iw as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from benchmark where text is not null),
wins as (
  select distinct item_id, least(len(w), 10) as size, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') as win
  from iw, unnest(range(1, len(w) - least(len(w), 10) + 2)) as u(k) where len(w) > 0),
dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
  from documents),
places as (
  select doc_id, k, s.size as size, array_to_string(w[k : k + s.size - 1], ' ') as win
  from dw, (select distinct size from wins) s, unnest(range(1, len(w) - s.size + 2)) as u(k)),
found as (select p.doc_id, p.k, p.size, i.item_id from places p join wins i on p.size = i.size and p.win = i.win),
hit as (select doc_id, count(distinct k + o) as n_hit from (select distinct doc_id, k, size from found), unnest(range(0, size)) as u(o) group by doc_id),
items as (select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as sha from (select distinct doc_id, cast(item_id as varchar) as item_id from found) group by doc_id)
select dw.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(items.sha, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join hit on dw.doc_id = hit.doc_id left join items on dw.doc_id = items.doc_id
"""
