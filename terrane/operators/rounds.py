"""State of iterative plans: each round's table is written to the shared folder, and the one before dropped."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; one of our own only for a local master without that setting."""
    at = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = at.get() if at.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return os.path.abspath("spark-warehouse/rounds")
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


class Rounds:
    """Tables of one iteration. A written table cuts the lineage and outlives its executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.number = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4()}", 0
        self.now: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df written under a name; the table that had this name is dropped afterwards, so df may be made from it."""
        self.number += 1
        path, before = f"{self.folder}/{self.number}-{name}", self.now.get(name)
        df.write.parquet(path)
        self.now[name] = path
        if before:
            self._delete(before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.now:
                self._delete(self.now.pop(name))

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
