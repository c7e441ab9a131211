"""Registry tables as XML inside a zip: one entry a partition, parsed as a stream."""

from __future__ import annotations

import datetime
import sys
import zipfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, DateType, DecimalType, DoubleType, FloatType, IntegralType, StructType, TimestampType

from .files import open_at
from .registry_files import xml_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(sys.modules[open_at.__module__])

REGION, ENTRY = "region", "entry"


class _Entry(InputPartition):
    def __init__(self, entry: str, region: str | None):
        self.entry, self.region = entry, region


def value_of(text: str | None, kind):
    """An attribute as a value of a column's type; blank and malformed ones are null."""
    if text is None or (text.strip() == "" and not kind.typeName() == "string"):
        return None
    try:
        if isinstance(kind, IntegralType):
            return int(text)
        if isinstance(kind, (DoubleType, FloatType)):
            return float(text)
        if isinstance(kind, DecimalType):
            from decimal import Decimal

            return Decimal(text)
        if isinstance(kind, BooleanType):
            return text.strip().lower() in ("1", "true")
        if isinstance(kind, DateType):
            return datetime.date.fromisoformat(text.strip()[:10])
        if isinstance(kind, TimestampType):
            return datetime.datetime.fromisoformat(text.strip())
    except (ValueError, ArithmeticError):
        return None
    return text


def rows_of(f, names: list[str], kinds: list):
    """Values of the attributes of each child of the root, element by element; a parsed one is freed at once."""
    from xml.etree.ElementTree import iterparse

    depth, root = 0, None
    for event, element in iterparse(f, events=("start", "end")):
        if event == "start":
            depth += 1
            root = element if depth == 1 else root
        else:
            depth -= 1
            if depth == 1:
                yield tuple(value_of(element.attrib.get(n), k) for n, k in zip(names, kinds))
                root.clear()


class XmlZip(DataSource):
    """`format("xml_zip")`: the rows of one table (such as AS_HOUSES) of a registry zip, an attribute a column.

    Options: path (see files.open_at), table, region (a folder's number, or all). Entries whose names fit the table's mask are
    partitions; deflated entries can only be read from their start, so one entry is one task, in bounded
    memory. The schema is given; columns region and entry, if asked for, tell where a row is from. Attributes that a row
    lacks are null, others are ignored. An archive without such entries has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "xml_zip"

    def schema(self):
        raise ValueError("give the columns of the table with schema()")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _XmlReader(self.options["path"], self.options["table"].upper(), self.options.get("region"), schema)


class _XmlReader(DataSourceReader):
    def __init__(self, path: str, table: str, region: str | None, schema: StructType):
        self.path, self.table, self.region, self.fields = path, table, region, schema.fields

    def partitions(self):
        with open_at(self.path) as f, zipfile.ZipFile(f) as z:
            found = [(n, xml_table(n)) for n in z.namelist()]
        # a file beside the region folders belongs to every region
        return [_Entry(n, t[1]) for n, t in found if t and t[0] == self.table and (self.region is None or t[1] in (None, self.region))] or [_Entry("", None)]

    def read(self, p: _Entry):
        if not p.entry:
            return
        own = [f.name not in (REGION, ENTRY) for f in self.fields]
        names, kinds = [f.name for f, o in zip(self.fields, own) if o], [f.dataType for f, o in zip(self.fields, own) if o]
        with open_at(self.path) as f, zipfile.ZipFile(f) as z, z.open(p.entry) as entry:
            for values in rows_of(entry, names, kinds):
                it = iter(values)
                yield tuple(next(it) if o else p.region if f.name == REGION else p.entry for f, o in zip(self.fields, own))


def read_xml_zip(spark: SparkSession, path: str, table: str, schema: StructType | str, region: str | None = None) -> DataFrame:
    spark.dataSource.register(XmlZip)
    r = spark.read.format("xml_zip").schema(schema).option("path", path).option("table", table)
    return (r.option("region", region) if region else r).load()
