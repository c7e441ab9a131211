"""Trie of conversation prefixes: MSD radix partitioning of dictionary-encoded turns, finished bucket by bucket."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_value, small, table

by_value(__name__)

#: Turns that a bucket may have to be finished inside one task; larger ones are split by their next turn.
LOCAL_TURNS = 50_000
#: First turns that are borrowed: a conversation borrows fewer than HEADS from the first of its FAMILY.
HEADS, FAMILY = 4, 20
#: Ids whose text is joined into one piece before a node's ids are hashed: 2 ** PIECE_BITS of them, by their upper bits.
PIECE_BITS = 12

NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
NODE_COLUMNS = [c.split()[0] for c in NODE.split(", ")]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def encoded_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, pos, tid, words): each conversation's turns by number, null first, under the ids of a dictionary.

    The SHA-256 of role and text stands for a turn; the dictionary gives each one an
    integer. Turns of equal number go by role, then by that hash. Rows are
    ranged by (conversation, turn) and places counted per range, with an offset for the
    conversation that a range continues, so one conversation of any length is
    spread over many tasks.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    own = F.unhex(F.sha2(F.concat_ws(":", F.length(role), role, text), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), own.alias("sha"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    rows = scratch.keep(rows, "turns")
    known = scratch.keep(rows.groupBy("sha").agg(F.max("words").alias("words")).select("sha", F.monotonically_increasing_id().alias("tid")), "dictionary")
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "sha"]
    placed = rows.join(known, "sha").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = scratch.keep(placed.select("conv_id", "tid", "words", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "placed")
    scratch.drop("turns", "dictionary")
    pieces = placed.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    carried = pieces.select("conv_id", "range", before.alias("before")).where("before > 0")  # at most one conversation a range
    local = placed.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "range").orderBy("at")) - 1)
    return local.join(F.broadcast(carried), ["conv_id", "range"], "left").select("conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).cast("int").alias("pos"), "tid", "words")


def rebuilt_turns(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, tid, words) and (conv_id, len) of conversations that begin with borrowed turns.

    The first h turns of conversation c - c % 20, then c's own after its first h; h is crc32 of the decimal c, mod 4.
    """
    turns = scratch.keep(turns, "own")
    scratch.drop("placed")
    n = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    heads = n.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")).where(F.col("base") % FAMILY == 0)
    convs = n.join(heads, "base", "left").select("conv_id", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("lent"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("kept"))
    convs = scratch.keep(convs, "convs")
    first = turns.where((F.col("pos") < HEADS - 1) & (F.col("conv_id") % FAMILY == 0)).withColumnRenamed("conv_id", "base")
    borrowed = convs.where("lent > 0").join(first, "base").where("pos < h").select("conv_id", "pos", "tid", "words")
    own = turns.join(convs.where("kept > 0"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).cast("int").alias("pos"), "tid", "words")
    lens = convs.select("conv_id", (F.col("lent") + F.col("kept")).cast("int").alias("len"))
    out = scratch.keep(borrowed.unionByName(own).sortWithinPartitions("pos"), "rebuilt"), scratch.keep(lens, "lens")
    scratch.drop("own", "convs")
    return out


def finish(convs: np.ndarray, turns: np.ndarray, words: np.ndarray, starts: np.ndarray, lens: np.ndarray, depth: int, parent: int) -> list[list]:
    """Nodes of one bucket by multikey quicksort: members split three ways on their next turn, the equal ones recurse one turn deeper.

    convs ascend. Member i has lens[i] turns from starts[i]. The bucket hangs
    below node (parent, depth). Returns the columns of NODE and, last, whether a node is the bucket's top.
    """
    conv, up, deep, count, kids, leaves, saved, ends = [], [], [], [], [], [], [], []

    def emit(first, above, at, n, word_count, ended):
        conv.append(first), up.append(above), deep.append(at), count.append(n), kids.append(0), leaves.append(0)
        saved.append((n - 1) * word_count)
        ends.append(hashlib.sha256(",".join(map(str, ended)).encode()).hexdigest() if ended else EMPTY_SHA)
        if above >= 0:
            kids[above] += 1
        return len(conv) - 1

    stack = [(np.arange(len(convs)), 0, -1)]
    while stack:
        members, k, above = stack.pop()
        if len(members) == 1:
            m = int(members[0])
            c, n = int(convs[m]), int(lens[m])
            for at in range(k, n):
                above = emit(c, above, depth + at + 1, 1, 0, [c] if at + 1 == n else None)
            continue
        digit = turns[starts[members] + k]
        pivot = digit[len(digit) // 2]
        for side in (members[digit < pivot], members[digit > pivot]):
            if len(side):
                stack.append((side, k, above))
        same = members[digit == pivot]
        done = lens[same] == k + 1
        node = emit(int(convs[same[0]]), above, depth + k + 1, len(same), int(words[starts[same[0]] + k]), convs[same[done]].tolist())
        on = same[~done]
        if len(on):
            stack.append((on, k + 1, node))
    for i in range(len(conv) - 1, -1, -1):  # a node stands after the one above it
        if not kids[i]:
            leaves[i] = 1
        if up[i] >= 0:
            leaves[up[i]] += leaves[i]
            saved[up[i]] += saved[i]
    above = [conv[u] if u >= 0 else parent for u in up]
    return [conv, deep, above, count, kids, leaves, saved, ends, [u < 0 for u in up]]


def _local_nodes(rows: DataFrame) -> DataFrame:
    """NODE and top of the buckets (label, depth, digit) in rows (label, depth, digit, conv_id, seq); a task holds one bucket at a time."""

    def run(batches):
        key, convs, seqs = None, [], []

        def nodes():
            lens = np.fromiter(map(len, seqs), np.int64, len(seqs))
            flat = np.array([x for s in seqs for x in s], dtype=np.int64).reshape(-1, 2)
            cols = finish(np.array(convs, np.int64), flat[:, 0], flat[:, 1], np.cumsum(lens) - lens, lens, key[1], key[0])
            kinds = [pa.int64()] * 7 + [pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [*NODE_COLUMNS, "top"])

        for b in batches:
            seq = b.column(4)
            pairs = np.stack([seq.values.field(0).to_numpy(zero_copy_only=False), seq.values.field(1).to_numpy(zero_copy_only=False)], axis=1)
            bounds = seq.offsets.to_numpy()
            for i, (label, depth, digit, conv) in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)))):
                if key != (label, depth, digit):
                    if key:
                        yield nodes()
                    key, convs, seqs = (label, depth, digit), [], []
                convs.append(conv)
                seqs.append(pairs[bounds[i] : bounds[i + 1]])
        if key:
            yield nodes()

    return rows.mapInArrow(run, f"{NODE}, top boolean")


def _ends(ended: DataFrame) -> DataFrame:
    """(label, depth, ends_sha256) of the conversations (label, depth, conv_id) that end at nodes of any size, hashed as a stream."""
    piece = F.shiftright("conv_id", PIECE_BITS).alias("piece")
    joined = ended.groupBy("label", "depth", piece).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    joined = joined.repartition("label", "depth").sortWithinPartitions("label", "depth", "piece")

    def run(batches):
        key, sha = None, None
        names = ["label", "depth", "ends_sha256"]
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([sha.hexdigest()])], names)
        for b in batches:
            for label, depth, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                if key == (label, depth):
                    sha.update(b",")
                else:
                    if key:
                        yield row()
                    key, sha = (label, depth), hashlib.sha256()
                sha.update(ids.encode())
        if key:
            yield row()

    return joined.mapInArrow(run, "label bigint, depth bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations (columns conv_id, turn, role, text).

    A bucket is the conversations below one node; its label is the smallest, so
    (label, depth) names the node. Level by level the buckets of over
    local_turns turns are split by their next turn: an aggregate with partial sums,
    so a first turn or a conversation that a third of all rows share is never one
    group. Buckets under the bound go to tasks, which finish them by
    multikey quicksort; a single conversation that is over it needs no sorting, and its
    nodes are its rows. Then leaves and saved tokens are summed up the split levels.
    The work needs one step for each turn that more than local_turns turns' worth of conversations share.

    Null roles and texts are empty texts; rows without a conv_id belong to no
    conversation; repeated rows are turns like others; an empty table gives no
    rows; other columns are ignored.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    turns, lens = rebuilt_turns(encoded_turns(conversations.select("conv_id", "turn", "role", "text"), scratch), scratch)
    root = lens.agg(F.min("conv_id").alias("label"), F.count(F.lit(1)).alias("n")).where("n > 0")
    state = scratch.keep(lens.join(F.broadcast(root.select("label"))).select("conv_id", "label", "len"), "state0")
    split = [root.select("label", F.lit(None).cast("bigint").alias("parent"), F.col("n").alias("n_convs"), F.lit(0).cast("bigint").alias("own"))]
    locals_, tails, kids, ended, d = [], [], [], [], 0
    while True:
        ended.append(state.where(F.col("len") == d).select("label", F.lit(d).cast("bigint").alias("depth"), "conv_id"))
        met = state.where(F.col("len") > d).join(turns.where(F.col("pos") == d).select("conv_id", "tid", "words"), "conv_id")
        met = scratch.keep(met, f"met{d}")
        below = met.groupBy("label", "tid").agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n"), F.sum(F.col("len") - d).alias("turns"), F.max("words").alias("w"))
        below = scratch.keep(below, f"below{d}")
        kids.append(below.groupBy("label").agg(F.count(F.lit(1)).alias("n_children")))
        large = below.where(F.col("turns") > local_turns).select("label", "tid", "conv", "n", "w")
        # at most one in local_turns turns: the share is bounded, and so its size is checked
        got = met.join(small(large), ["label", "tid"], "left")
        locals_.append(got.where("conv is null").select("conv_id", "label", F.lit(d).alias("depth"), F.col("tid").alias("digit")))
        tails.append(got.where("n = 1").select("conv_id", "label", F.lit(d).alias("depth"), "len"))
        more = large.where("n > 1")
        split.append(more.select(F.col("conv").alias("label"), F.col("label").alias("parent"), F.col("n").alias("n_convs"), ((F.col("n") - 1) * F.col("w")).alias("own")))
        if more.isEmpty():
            break
        state = scratch.keep(got.where("n > 1").select("conv_id", F.col("conv").alias("label"), "len"), f"state{d + 1}")
        d += 1
    every = lambda parts: reduce(DataFrame.unionByName, parts)

    here = turns.join(every(locals_), "conv_id").where("pos >= depth")
    seq = F.transform(F.array_sort(F.collect_list(F.struct("pos", "tid", F.col("words").cast("bigint").alias("words")))), lambda t: F.struct(t["tid"].alias("tid"), t["words"].alias("words")))
    buckets = here.groupBy("conv_id", F.col("label"), F.col("depth"), F.col("digit")).agg(seq.alias("seq")).select("label", "depth", "digit", "conv_id", "seq")
    done = scratch.keep(_local_nodes(buckets.repartition("label", "depth", "digit").sortWithinPartitions("label", "depth", "digit", "conv_id")), "local")

    deep = F.col("pos") + 1
    last = deep == F.col("len")
    lone = turns.join(every(tails), "conv_id").where("pos >= depth").select(
        "conv_id", deep.cast("bigint").alias("depth"), F.when(F.col("pos") == F.col("depth"), F.col("label")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("bigint").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(EMPTY_SHA).alias("ends_sha256"), (F.col("pos") == F.col("depth")).alias("top"),
    )
    done = done.unionByName(lone)

    # Up the split levels: what hangs below a node, in tasks or as a level of its own.
    hung = scratch.keep(done.where("top").groupBy(F.col("parent_conv_id").alias("label"), (F.col("depth") - 1).alias("depth")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")), "hung")
    levels, lower = [], None
    for k in range(len(split) - 1, -1, -1):
        sums = hung.where(F.col("depth") == k).select("label", "leaves", "saved")
        if lower is not None:
            sums = sums.unionByName(lower.select(F.col("parent").alias("label"), "leaves", "saved"))
        sums = sums.groupBy("label").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        at = split[k].join(sums, "label", "left").select("label", "parent", "n_convs", F.lit(k).cast("bigint").alias("depth"), F.coalesce("leaves", F.lit(1)).alias("leaves"), (F.col("own") + F.coalesce("saved", F.lit(0))).alias("saved"))
        lower = scratch.keep(at, f"level{k}")
        levels.append(lower)
    branches = every([c.withColumn("depth", F.lit(k).cast("bigint")) for k, c in enumerate(kids)])
    top = every(levels).join(branches, ["label", "depth"], "left").join(_ends(every(ended)), ["label", "depth"], "left").select(
        F.col("label").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
    return done.select(*NODE_COLUMNS).unionByName(top)


#: crc32 of a decimal number's text.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: ascii(x)::bigint)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"

OP11_SQL = rf"""with o as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos from conversations where conv_id is not null),
c as (select conv_id, {_CRC} % 4 as h, conv_id - conv_id % 20 as base from (select distinct conv_id from o)),
r as (select c.conv_id, o.pos, o.role, o.text from c join o on o.conv_id = c.base and o.pos < c.h union all select c.conv_id, o.pos + 4, o.role, o.text from c join o on o.conv_id = c.conv_id and o.pos >= c.h),
s as (select c.conv_id, coalesce(list(md5(r.role || chr(0) || r.text) order by r.pos) filter (r.pos is not null), []) as seq, coalesce(list(len(regexp_extract_all(r.text, '[^\x20\x09-\x0D]+')) order by r.pos) filter (r.pos is not null), []) as words from c left join r on r.conv_id = c.conv_id group by c.conv_id),
p as (select conv_id, d, seq[1:d] as path, case when d > 0 then words[d] else 0 end as w from s, unnest(range(0, len(seq) + 1)) as u(d)),
g as (select path, d, min(conv_id) as conv_id, count(*) as n, max(w) as w from p group by path, d),
k as (select path[1:d - 1] as path, d - 1 as d, count(*) as n_children from g where d > 0 group by 1, 2),
x as (select g.*, coalesce(n_children, 0) as n_children from g left join k using (path, d)),
t as (select a.path, a.d, sum(case when b.n_children = 0 then 1 else 0 end) as n_leaves, sum((b.n - 1) * b.w) as saved_tokens from x a join x b on b.d >= a.d and b.path[1:a.d] = a.path group by a.path, a.d),
e as (select seq as path, len(seq) as d, sha256(string_agg(cast(conv_id as varchar), ',' order by conv_id)) as ends from s group by seq)
select x.conv_id, cast(x.d as bigint) as depth, up.conv_id as parent_conv_id, x.n as n_convs, x.n_children, cast(t.n_leaves as bigint) as n_leaves, cast(t.saved_tokens as bigint) as saved_tokens, coalesce(e.ends, sha256('')) as ends_sha256
from x join t using (path, d) left join e using (path, d) left join g up on x.d > 0 and up.d = x.d - 1 and up.path = x.path[1:x.d - 1]"""


def op11(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
