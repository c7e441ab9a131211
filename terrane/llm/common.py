"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"


def by_value(module_name: str) -> None:
    """Send the functions of a module to executors by value, not by import."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir.

    A folder of our own is set only for a local master without that setting; on
    a cluster a machine-local folder would be lost with its machine, so there
    the missing setting is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        sc.setCheckpointDir(os.path.abspath("spark-warehouse/checkpoints"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Drops a query's shuffle files as soon as it has ended; what it wrote is what later steps read.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that may be broadcast (a few longs each, under 50 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


class Scratch:
    """Tables that an operator writes for its own later steps, in the shared checkpoint folder.

    Like a checkpoint, a written table cuts the lineage and outlives its
    executors; unlike one it is compressed, read by columns and dropped as soon as
    no later step needs it. What the operator's result still reads stays until the
    caller clears the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4()}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """df as a written table. The shuffle files of the query that makes it are dropped when it is written."""
        before = self.spark.conf.get(SHUFFLE_CLEANUP, "false")
        self.spark.conf.set(SHUFFLE_CLEANUP, "true")
        try:
            df.write.parquet(f"{self.folder}/{name}")
        finally:
            self.spark.conf.set(SHUFFLE_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables by name, or the whole folder without a name."""
        for path in [f"{self.folder}/{n}" for n in names] or [self.folder]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int = 0) -> DataFrame:
    """df marked for a broadcast if its checked size allows it: the rows it has, or `rows` where one row holds more than a few longs."""
    return F.broadcast(df) if (rows or df.count()) <= BROADCAST_ROWS else df


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just (doc_id, text) with null texts as empty ones; other columns cannot clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def held_out(id_col: str = "doc_id"):
    """True for the rows whose labels must not be learnt from: crc32(id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named by their places (_0, _1, …), so that no name of ours can clash with one of theirs."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def named_as(df: DataFrame, like: DataFrame) -> DataFrame:
    """The first columns of a numbered frame under the names of the frame it came from."""
    return df.select(*[f"_{i}" for i in range(len(like.columns))]).toDF(*like.columns)
