"""Best-fit packing of token pieces into sequences of bounded length."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZER_DIR, by_value, checkpointed, id_and_text, table
from .tokens import reader

by_value(__name__)

#: Bins that a task keeps open. More than the pieces over half a sequence in a task's share, they seldom have to close early.
OPEN_BINS = 1 << 17
#: Pieces that one packing task gets, about.
PIECES_A_TASK = 400_000


class OpenBins:
    """A fixed number of open bins. Bit k of `free` is set if some open bin has k tokens of free space.

    A piece goes to the open bin that it fills best; if none can hold it, a
    new bin is opened, and the fullest open bin is closed first when all are taken.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.count = capacity, most, 0
        self.free, self.bins, self.opened = 0, [[] for _ in range(capacity + 1)], 0

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        fit = self.free >> length
        if fit:
            space = length + (fit & -fit).bit_length() - 1
            number = self._take(space)
        else:
            if self.count >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            number, space = self.opened, self.capacity
            self.opened += 1
        left = space - length
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.count += 1
        return number, self.capacity - space

    def _take(self, space: int) -> int:
        number = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        self.count -= 1
        return number


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, vocabulary: str = "byte_bpe_50k.json", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and one id 0, cut where longer than capacity.

    The first piece takes what is left over; all others are full.
    """
    path = os.path.join(tokenizer_dir, vocabulary)

    def batches(it):
        of = reader(path)
        for b in it:
            rows, number, start, length, crc = [], [], [], [], []
            for row, text in enumerate(b.column(1).to_pylist()):
                ids = of.ids(text) + b"\0\0\0\0"
                n, at, k = len(ids) // 4, 0, 0
                to = n % capacity or capacity
                while at < n:
                    rows.append(row)
                    number.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * to]))
                    at, to, k = to, to + capacity, k + 1
            ids_of = b.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids_of, pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    docs = id_and_text(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(batches, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit_pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, open_bins: int = OPEN_BINS, pieces_a_task: int = PIECES_A_TASK, **tokenizer) -> DataFrame:
    """Pack all texts into sequences of at most capacity tokens.

    Pieces are encoded once, kept in the checkpoint folder, and dealt out by a
    hash to tasks of about pieces_a_task pieces, so a task packs a like mixture of
    lengths whatever the order of the input. Each task packs its pieces as
    they come, longest first, with a bounded number of open bins.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row
    per piece. Null text counts as empty: one token, id 0. Repeated rows and null
    ids are packed like any others. An empty table gives no rows; other columns
    are ignored.
    """
    parts = checkpointed(pieces(df, id_col, text_col, capacity, **tokenizer))
    n_tasks = max(1, round(parts.count() / pieces_a_task))
    names = parts.columns
    schema = parts.select("doc_id", "piece", "start", "length", "ids_crc32").schema

    def pack(it):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        bins = OpenBins(capacity, open_bins)
        for b in it:
            put = [bins.put(n) for n in b.column(names.index("length")).to_pylist()]
            arrays = [*b.columns, pa.array([base + p[0] for p in put], pa.int64()), pa.array([p[1] for p in put], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "offset"])

    dealt = parts.repartition(n_tasks, F.xxhash64("doc_id", "piece", "ids_crc32")).sortWithinPartitions(F.desc("length"), "ids_crc32", "doc_id", "piece")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return dealt.mapInArrow(pack, f"{fields}, sequence_id bigint, offset bigint")


def op1(spark, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))
