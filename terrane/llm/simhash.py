"""SimHash near-duplicates: fingerprints, vantage-point shards, exact pairs, components.

Two fingerprints that differ in at most `max_bits` bits differ in at most
max_bits // parts bits in one of `parts` equal parts of their 64 bits. One
vantage-point tree per part therefore searches with that smaller radius, under
the Hamming distance of the part: the triangle inequality prunes a branch when
the distance to the vantage point is more than the radius away from its side.
With the whole 64 bits and radius 3 nearly all branches of random fingerprints
would overlap; with two halves and radius 1 about a quarter do.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, checkpointed, id_and_text, table
from .components import connected_components

by_value(__name__)

SEED = 42
#: Fingerprints that the routing trees are fitted on, at most.
SAMPLE = 20_000
#: Fingerprints at home in a shard, about.
SHARD = 40_000
LEAF = 192


def fingerprint(raw: bytes, shingle: int = 3) -> int:
    """SimHash of UTF-8 bytes: A-Z lower-cased, words cut at ASCII white space, majority over XXH64 of shingles."""
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint's bits as a signed long; null text counts as empty."""

    def batches(it):
        for b in it:
            fps = [fingerprint(raw, shingle) for raw in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    docs = id_and_text(df, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(batches, f"doc_id {kind}, fp bigint")


def _bits(x):
    return np.bitwise_count(x).astype(np.int16)


def _vantage(points: np.ndarray, mask: np.uint64, rng) -> tuple | None:
    """Vantage point and threshold that divide points best, or None if no distance divides them."""
    best = None
    for v in rng.choice(points, min(6, len(points)), replace=False):
        d = _bits((points[:4096] ^ v) & mask)
        mu = int(np.median(d))
        for m in (mu - 1, mu):
            share = (d <= m).mean()
            if 0.1 < share < 0.9:
                crossing = ((d == m) | (d == m + 1)).mean()
                if best is None or crossing + abs(share - 0.5) < best[0]:
                    best = (crossing + abs(share - 0.5), v, m)
    return best and best[1:]


def build_router(sample: np.ndarray, mask: int, depth: int) -> list:
    """Vantage tree over a sample, as a list of nodes (vantage, threshold, inner, outer) or ("leaf", number)."""
    rng, nodes, leaves = np.random.default_rng(7), [], [0]

    def grow(points, left):
        at = len(nodes)
        nodes.append(None)
        split = _vantage(points, np.uint64(mask), rng) if left and len(points) >= 16 else None
        if split is None:
            nodes[at] = ("leaf", leaves[0])
            leaves[0] += 1
        else:
            v, mu = split
            inner = _bits((points ^ v) & np.uint64(mask)) <= mu
            nodes[at] = (np.uint64(v), mu, grow(points[inner], left - 1), grow(points[~inner], left - 1))
        return at

    grow(sample, depth)
    return nodes


def route(nodes: list, mask: int, radius: int, x: np.ndarray) -> list:
    """(shard, indexes of x, whether x is at home there): the home of each x and the shards its radius overlaps."""
    out, todo = [], [(0, np.arange(len(x)), np.ones(len(x), dtype=bool))]
    while todo:
        at, idx, home = todo.pop()
        if not len(idx):
            continue
        if nodes[at][0] == "leaf":
            out.append((nodes[at][1], idx, home))
            continue
        v, mu, inner, outer = nodes[at]
        d = _bits((x[idx] ^ v) & np.uint64(mask))
        near, far = d - radius <= mu, d + radius > mu
        todo.append((inner, idx[near], home[near] & (d[near] <= mu)))
        todo.append((outer, idx[far], home[far] & (d[far] > mu)))
    return out


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) thinned to stars that connect the same points."""
    ids, pos = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = pos[: len(a)], pos[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(ids))
    return ids[keep], ids[label[keep]]


def shard_edges(points: np.ndarray, home: np.ndarray, mask: int, radius: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what exact pairs (home point, any point) of a shard connect.

    A vantage tree over the shard: queries go to both sides of a threshold when
    their radius crosses it. A leaf's pairs are checked over all 64 bits. Where
    the part's distance divides nothing more, the tree goes on with the whole 64
    bits and radius max_bits. Edges are thinned to spanning stars leaf by leaf.
    """
    rng, found = np.random.default_rng(11), []
    whole = 0xFFFFFFFFFFFFFFFF
    todo = [(points[home], points, mask, radius)]
    while todo:
        p, q, m, r = todo.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > LEAF:
            split = _vantage(p, np.uint64(m), rng)
            if split is None and m != whole:
                todo.append((p, q, whole, max_bits))
                continue
            if split is not None:
                v, mu = split
                dp, dq = _bits((p ^ v) & np.uint64(m)), _bits((q ^ v) & np.uint64(m))
                todo.append((p[dp <= mu], q[dq - r <= mu], m, r))
                todo.append((p[dp > mu], q[dq + r > mu], m, r))
                continue
        a, b = [], []
        step = max(1, 2_000_000 // len(q))
        for at in range(0, len(p), step):
            i, j = np.nonzero(np.bitwise_count(p[at : at + step, None] ^ q[None, :]) <= max_bits)
            x, y = p[at + i], q[j]
            other = x != y
            if other.any():
                x, y = _forest(x[other], y[other])
                a.append(x)
                b.append(y)
        if a:
            found.append(_forest(np.concatenate(a), np.concatenate(b)))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return _forest(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))


def fingerprint_edges(fps: DataFrame, max_bits: int = 3, parts: int = 2, shard: int = SHARD) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints (column fp) that connect all pairs within max_bits."""
    n = fps.count()
    width = 64 // parts
    masks = [((1 << width) - 1) << (width * k) for k in range(parts)]
    radius = max_bits // parts
    depth = max(0, math.ceil(math.log2(max(1, n / shard))))
    some = fps.where(F.pmod(F.xxhash64("fp", F.lit(5)), F.lit(1_000_000)) < math.ceil(1e6 * min(1.0, SAMPLE / max(1, n)))).limit(2 * SAMPLE)
    sample = np.array([r.fp for r in some.collect()], dtype=np.int64).view(np.uint64)
    sample.sort()
    routers = [build_router(sample, m, depth) for m in masks]

    def deal(it):
        for b in it:
            x = b.column(0).to_numpy().view(np.uint64)
            for tree, (nodes, m) in enumerate(zip(routers, masks)):
                for leaf, idx, home in route(nodes, m, radius, x):
                    k = len(idx)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, tree, np.int32)), pa.array(np.full(k, leaf, np.int32)), pa.array(x[idx].view(np.int64)), pa.array(home)], ["tree", "shard", "fp", "home"]
                    )

    def pairs(key, group):
        tree = key[0].as_py()
        x = group.column("fp").to_numpy().view(np.uint64)
        a, b = shard_edges(x, group.column("home").to_numpy(), masks[tree], radius, max_bits)
        return pa.table({"src": a.view(np.int64), "dst": b.view(np.int64)})

    return fps.mapInArrow(deal, "tree int, shard int, fp bigint, home boolean").groupBy("tree", "shard").applyInArrow(pairs, "src bigint, dst bigint")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """Fingerprint every document and connect fingerprints that differ in at most max_bits bits.

    Returns doc_id, fingerprint (16 hex digits), component_id (smallest doc_id
    reachable): one row per input row. Null text counts as empty; texts without
    words have fingerprint zero and link like any other. Equal fingerprints
    meet once before the search, whatever their number. A null id is never the
    smallest unless all are null. An empty table gives no rows; other columns are
    ignored.
    """
    docs = checkpointed(fingerprints(df, id_col, text_col, shingle))
    fps = checkpointed(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    edges = fingerprint_edges(fps.select("fp"), max_bits)
    linked = connected_components(edges)
    roots = fps.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = roots.join(smallest, "root").select(F.col("fp").alias("f"), "component_id")
    return docs.join(by_fp, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
