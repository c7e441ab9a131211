"""Incremental jobs as streams: new files since the last run, merged by key, progress kept in the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import latest_wins


def new_rows(spark: SparkSession, folder: str, schema, **options) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).options(**options).parquet(folder)


def run_once(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand all that is new to work(batch, number) and stop; the checkpoint is the watermark of the next run."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_into(folder: str, keys: list[str], version: str | None = None) -> Callable[[DataFrame, int], None]:
    """Work that merges each batch into a table of numbered snapshots. A batch that is done again writes the same snapshot."""

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = snapshot(spark, folder, number - 1)
        merged = batch if before is None else latest_wins(before, batch, keys, version)
        if before is None:
            merged = latest_wins(batch.limit(0), batch, keys, version)
        merged.write.mode("overwrite").parquet(f"{folder}/v={number}")

    return work


def snapshot(spark: SparkSession, folder: str, number: int) -> DataFrame | None:
    """The table after a batch. Only before batch 0 is there none; a lost snapshot is an error, not an empty table."""
    return None if number < 0 else spark.read.parquet(f"{folder}/v={number}")


def tumbling_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts per window and kind; rows later than `late` behind the newest are dropped with their state."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
