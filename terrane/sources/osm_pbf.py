"""Map extracts in PBF: a data source of nodes, ways and relations, one partition per run of blocks."""

from __future__ import annotations

import struct
import sys
import zlib

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import open_at

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(sys.modules[open_at.__module__])

SCHEMA = "type string, id bigint, lat double, lon double, tags map<string,string>, nodes array<bigint>, members array<struct<id:bigint,role:string,type:int>>"


def varint(b, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        n |= (x & 127) << shift
        at += 1
        if x < 128:
            return n, at
        shift += 7


def signed(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def fields(b):
    """(number, value) of a message's fields; values are numbers or bytes."""
    at, end = 0, len(b)
    while at < end:
        key, at = varint(b, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(b, at)
        elif kind == 2:
            size, at = varint(b, at)
            value, at = b[at : at + size], at + size
        elif kind == 5:
            value, at = b[at : at + 4], at + 4
        else:
            value, at = b[at : at + 8], at + 8
        yield key >> 3, value


def packed(b) -> np.ndarray:
    """Packed varints as unsigned 64-bit numbers, all at once: each byte's seven bits, shifted to their place and summed."""
    x = np.frombuffer(b, dtype=np.uint8)
    ends = np.flatnonzero(x < 128)
    if not len(ends):
        return np.empty(0, dtype=np.uint64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(ends[-1] + 1) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((x[: ends[-1] + 1] & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def numbers(b) -> list[int]:
    return packed(b).tolist()


def running(b) -> list[int]:
    """Delta-coded signed numbers."""
    n = packed(b)
    return np.cumsum((n >> np.uint64(1)).astype(np.int64) ^ -(n & np.uint64(1)).astype(np.int64)).tolist()


def blobs(f):
    """(kind, offset, size) of a file's blobs."""
    while head := f.read(4):
        header = dict(fields(f.read(struct.unpack(">I", head)[0])))
        size = header[3]
        yield bytes(header[1]).decode(), f.tell(), size
        f.seek(size, 1)


def unpack(blob) -> bytes:
    b = dict(fields(blob))
    return bytes(b[1]) if 1 in b else zlib.decompress(bytes(b[3]))


def elements(block):
    """Rows of a primitive block."""
    strings, groups, scale, lat0, lon0 = [], [], 100, 0, 0
    for k, v in fields(memoryview(block)):
        if k == 1:
            strings = [bytes(s).decode("utf-8") for _, s in fields(v)]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            scale = v
        elif k == 19:
            lat0 = v - (1 << 64) if v >> 63 else v
        elif k == 20:
            lon0 = v - (1 << 64) if v >> 63 else v
    degrees = lambda n, zero: (zero + scale * n) * 1e-9
    bag = lambda d: {strings[k]: strings[v] for k, v in zip(numbers(d.get(2, b"")), numbers(d.get(3, b"")))}
    for g in groups:
        for k, v in fields(g):
            if k == 1:
                d = dict(fields(v))
                yield ("node", signed(d[1]), degrees(signed(d[8]), lat0), degrees(signed(d[9]), lon0), bag(d), None, None)
            elif k == 2:
                d = dict(fields(v))
                tags, kv = [], iter(numbers(d.get(10, b"")))
                ids = running(d.get(1, b""))
                for _ in ids:
                    own = {}
                    for key in kv:
                        if key == 0:
                            break
                        own[strings[key]] = strings[next(kv)]
                    tags.append(own)
                for i, y, x, t in zip(ids, running(d.get(8, b"")), running(d.get(9, b"")), tags):
                    yield ("node", i, degrees(y, lat0), degrees(x, lon0), t, None, None)
            elif k == 3:
                d = dict(fields(v))
                yield ("way", d[1], None, None, bag(d), running(d.get(8, b"")), None)
            elif k == 4:
                d = dict(fields(v))
                members = [(i, strings[r], t) for i, r, t in zip(running(d.get(9, b"")), numbers(d.get(8, b"")), numbers(d.get(10, b"")))]
                yield ("relation", d[1], None, None, bag(d), None, members)


class _Blocks(InputPartition):
    def __init__(self, path: str, places: list[tuple[int, int]]):
        self.path, self.places = path, places


class OsmPbf(DataSource):
    """`format("osm_pbf")`: elements of an extract in file order. Options: path (see files.open_at), blocks (a partition, 16)."""

    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _PbfReader(self.options["path"], int(self.options.get("blocks", 16)))


class _PbfReader(DataSourceReader):
    def __init__(self, path: str, blocks: int):
        self.path, self.blocks = path, blocks

    def partitions(self):
        with open_at(self.path) as f:
            places = [(at, size) for kind, at, size in blobs(f) if kind == "OSMData"]
        return [_Blocks(self.path, places[k : k + self.blocks]) for k in range(0, len(places), self.blocks)]

    def read(self, p: _Blocks):
        with open_at(p.path) as f:
            for at, size in p.places:
                f.seek(at)
                yield from elements(unpack(f.read(size)))


def read_osm_pbf(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(OsmPbf)
    return spark.read.format("osm_pbf").option("path", path).load()
