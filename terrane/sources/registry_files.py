"""Registry archives: zipped DBF tables and zipped or plain XML tables."""

from __future__ import annotations

import re
import struct
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .files import open_at

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(sys.modules[open_at.__module__])

# Registry tables by file-name mask and the key of each.
DBF_KEYS = {"addrob": "aoid", "house": "houseid", "room": "roomid", "stead": "steadid", "socrbase": "kod_t_st", "eststat": "eststatid", "daddrob": "aoid", "dhouse": "houseid", "droom": "roomid", "dstead": "steadid"}
XML_TABLES = (
    "ADDR_OBJ ADDR_OBJ_DIVISION ADDR_OBJ_TYPES ADM_HIERARCHY APARTMENTS APARTMENT_TYPES CARPLACES CHANGE_HISTORY HOUSES HOUSE_TYPES MUN_HIERARCHY NORMATIVE_DOCS "
    "NORMATIVE_DOCS_KINDS NORMATIVE_DOCS_TYPES OBJECT_LEVELS OPERATION_TYPES PARAM PARAM_TYPES REESTR_OBJECTS ROOMS ROOM_TYPES STEADS"
).split()


def dbf_table(file_name: str) -> tuple[str, str | None] | None:
    """(table, region) of a DBF file name such as ADDROB01.DBF, or None if no mask fits."""
    m = re.fullmatch(r"(?i)([a-z]+?)(\d*)\.dbf", file_name.rsplit("/", 1)[-1])
    return (m[1].lower(), m[2] or None) if m and m[1].lower() in DBF_KEYS else None


def xml_table(file_name: str) -> tuple[str, str | None] | None:
    """(table, region folder) of a name such as 77/AS_HOUSES_20240101_<guid>.XML; parameter files share one table."""
    m = re.fullmatch(r"(?i)(?:.*?(?:^|/)(\d+)/)?(?:.*/)?AS_([A-Z_]+?)_(\d{8})_[0-9a-f-]+\.xml", file_name)
    if not m:
        return None
    name = m[2].upper()
    if name.endswith("_PARAMS"):
        name = "PARAM"
    return ("AS_" + name, m[1]) if name in XML_TABLES else None


def dbf_header(head: bytes) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """(rows, header bytes, row bytes, fields (name, type, length, decimals)) of a DBF file."""
    rows, header, width = struct.unpack_from("<IHH", head, 4)
    fields = []
    at = 32
    while at + 32 <= header and head[at] != 0x0D:
        name = head[at : at + 11].split(b"\0")[0].decode("ascii").lower()
        fields.append((name, chr(head[at + 11]), head[at + 16], head[at + 17]))
        at += 32
    return rows, header, width, fields


def dbf_kind(field: tuple[str, str, int, int]) -> str:
    _, kind, length, decimals = field
    return {"N": f"decimal({min(38, max(1, length))},{decimals})", "F": "double", "D": "date", "L": "boolean"}.get(kind, "string")


def dbf_value(raw: bytes, field, encoding: str):
    import datetime
    from decimal import Decimal, InvalidOperation

    kind, text = field[1], raw.decode(encoding).strip(" \0")
    if not text:
        return None
    if kind == "N":
        try:
            return Decimal(text).quantize(Decimal(1).scaleb(-field[3]))
        except InvalidOperation:
            return None
    if kind == "F":
        return float(text)
    if kind == "D":
        return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:8])) if text.isdigit() else None
    if kind == "L":
        return text in "YyTt"
    return text


class _Entry(InputPartition):
    def __init__(self, path: str, entry: str, region: str | None):
        self.path, self.entry, self.region = path, entry, region


class DbfZip(DataSource):
    """`format("dbf_zip")`: the rows of one table of a zip of DBF files. Options: path, table, region (a number, or all), encoding.

    An archive entry is a partition, read as a stream of fixed-width rows; for paths see
    files.open_at. A file without rows gives none.
    """

    @classmethod
    def name(cls) -> str:
        return "dbf_zip"

    def entries(self) -> list[_Entry]:
        import zipfile

        table, region = self.options["table"].lower(), self.options.get("region")
        with open_at(self.options["path"]) as archive, zipfile.ZipFile(archive) as z:
            found = [(n, dbf_table(n)) for n in z.namelist()]
        return [_Entry(self.options["path"], n, t[1]) for n, t in found if t and t[0] == table and region in (None, t[1])]

    def schema(self) -> str:
        import zipfile

        entries = self.entries()
        if not entries:
            return "region string"
        with open_at(entries[0].path) as archive, zipfile.ZipFile(archive) as z, z.open(entries[0].entry) as f:
            fields = dbf_header(f.read(65535))[3]
        return ", ".join(["region string", *(f"`{f[0]}` {dbf_kind(f)}" for f in fields)])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _DbfReader(self.entries(), self.options.get("encoding", "cp866"))


class _DbfReader(DataSourceReader):
    def __init__(self, entries: list[_Entry], encoding: str):
        self.entries, self.encoding = entries, encoding

    def partitions(self):
        return self.entries

    def read(self, p: _Entry):
        import zipfile

        with open_at(p.path) as archive, zipfile.ZipFile(archive) as z, z.open(p.entry) as f:
            head = f.read(32)
            size = struct.unpack_from("<H", head, 8)[0]
            rows, _, width, fields = dbf_header(head + f.read(size - 32))
            for _ in range(rows):
                row = f.read(width)
                if len(row) < width:
                    return
                if row[:1] == b"*":  # a deleted row
                    continue
                at, values = 1, []
                for field in fields:
                    values.append(dbf_value(row[at : at + field[2]], field, self.encoding))
                    at += field[2]
                yield (p.region, *values)


def read_dbf_zip(spark: SparkSession, path: str, table: str, region: str | None = None) -> DataFrame:
    spark.dataSource.register(DbfZip)
    r = spark.read.format("dbf_zip").option("path", path).option("table", table)
    return (r.option("region", region) if region else r).load()


def read_xml_table(spark: SparkSession, paths, row_tag: str, schema: StructType | str) -> DataFrame:
    """One row per element, its attributes as columns; files are unpacked XML in a folder that Spark can list."""
    return spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "").schema(schema).load(paths).withColumn("source_file", F.col("_metadata.file_name"))
