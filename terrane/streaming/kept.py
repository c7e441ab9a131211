"""Tables kept in place by key: rows live in buckets by the hash of their key, and a batch rewrites the buckets it touches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import search

BUCKET = "__bucket"


class KeptTable:
    """Rows by key in Parquet files, one partition a bucket.

    A batch replaces all rows of its keys: its buckets are read, merged and written by a dynamic partition
    overwrite, which moves the new files in when the job commits; other buckets are not read. A rebuild
    writes everything anew beside the old files, and the pointer file that names the generation and its
    buckets is then replaced by one rename. A bucket that the pointer names and the
    store has lost is an error when it is read, never an empty one. One writer at a
    time; a batch that is done again gives the same rows.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = 64, version: str | None = None):
        self.spark, self.folder, self.keys, self.buckets, self.version = spark, folder.rstrip("/"), keys, buckets, version
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self) -> dict | None:
        at = self._path(f"{self.folder}/CURRENT")
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.folder}/CURRENT").collect())) if self._fs.exists(at) else None

    def _point(self, to: dict) -> None:
        fresh = self._path(f"{self.folder}/CURRENT-{uuid.uuid4()}")
        out = self._fs.create(fresh, True)
        try:
            out.write(bytearray(json.dumps(to).encode()))
        finally:
            out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), self.spark._jsc.hadoopConfiguration())
        option = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        flags = self.spark.sparkContext._gateway.new_array(option, 1)
        flags[0] = option.OVERWRITE
        context.rename(fresh, self._path(f"{self.folder}/CURRENT"), flags)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        rows = df
        if self.version:  # of a key's rows in one batch those of the largest version
            newest = df.groupBy(*self.keys).agg(F.max(self.version).alias("__newest"))
            rows = df.join(newest, self.keys).where(F.col(self.version) == F.col("__newest")).drop("__newest")
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, generation: str) -> None:
        rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.folder}/{generation}")

    def rebuild(self, df: DataFrame) -> None:
        """The whole table anew. Readers see the old one until the pointer moves; its files go after that."""
        before, generation = self._pointer(), f"g-{uuid.uuid4()}"
        self._write(self._bucketed(df), generation)
        there = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{generation}"))]
        self._point({"generation": generation, "buckets": sorted(int(n.split("=")[1]) for n in there if "=" in n), "schema": df.schema.json()})
        if before:
            self._fs.delete(self._path(f"{self.folder}/{before['generation']}"), True)

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets. None before the first rebuild or batch."""
        to = self._pointer()
        return None if to is None else self._rows(to, [b for b in to["buckets"] if only is None or b in set(only)])

    def _rows(self, to: dict, buckets: list[int]) -> DataFrame:
        from pyspark.sql.types import StructType

        schema, base = StructType.fromJson(json.loads(to["schema"])), f"{self.folder}/{to['generation']}"
        if not buckets:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{base}/{BUCKET}={b}" for b in buckets])

    def merge(self, batch: DataFrame) -> list[int]:
        """A batch whose rows replace all rows of their keys; the numbers of the buckets that were rewritten."""
        to = self._pointer()
        if to is None:
            self.rebuild(batch)
            return self._pointer()["buckets"]
        rows = self._bucketed(batch)
        touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())  # at most as many as there are buckets
        if touched:
            known = [b for b in to["buckets"] if b in set(touched)]
            before = self._rows(to, known).withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
            stay = before.join(rows.select(*self.keys).distinct(), self.keys, "left_anti")
            self._write(stay.unionByName(rows.select(*before.columns)), to["generation"])
            if set(touched) - set(known):
                self._point({**to, "buckets": sorted({*to["buckets"], *touched})})
        return touched


def merge_into(table: KeptTable) -> Callable[[DataFrame, int], None]:
    """Work for a stream's batches: each is merged into the table."""
    return lambda batch, number: table.merge(batch)


class SearchIndex:
    """Documents and their postings, both kept by document, as the writer of a search index."""

    def __init__(self, spark: SparkSession, folder: str, id_col: str, fields: list[str], buckets: int = 64, stems: bool = False):
        self.id_col, self.fields, self.stems = id_col, fields, stems
        self.docs = KeptTable(spark, f"{folder}/docs", [id_col], buckets)
        self.terms = KeptTable(spark, f"{folder}/postings", ["doc_id"], buckets)

    def _postings(self, docs: DataFrame) -> DataFrame:
        """Postings of documents; one without words has a row without a term, so that its older postings go."""
        words = search.postings(docs, self.id_col, self.fields, stems=self.stems)
        none = docs.select(F.col(self.id_col).alias("doc_id"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("term"))
        return words.select("doc_id", "field", F.col("pos").cast("bigint").alias("pos"), "term").unionByName(none)

    def rebuild(self, docs: DataFrame) -> None:
        self.docs.rebuild(docs)
        self.terms.rebuild(self._postings(docs))

    def merge(self, batch: DataFrame, number: int = 0) -> None:
        """Documents replace those of the same id, in both tables; also a stream's work."""
        self.docs.merge(batch)
        self.terms.merge(self._postings(batch))

    def postings(self) -> DataFrame:
        return self.terms.read().where("term is not null")
