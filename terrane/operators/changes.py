"""Incremental maintenance: upserts, first-wins inserts, tombstones, high-watermark deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_wins(base: DataFrame, delta: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Rows of base replaced or joined by those of delta. Of a key's delta rows the largest version (or row) wins.

    Whole rows meet in one aggregate with partial maxima; no window, no sort.
    """
    names = base.columns
    rows = base.withColumn("__side", F.lit(0)).unionByName(delta.select(*names).withColumn("__side", F.lit(1)))
    order = F.struct("__side", *([F.col(version)] if version else []), *[F.col(c) for c in names if c != version])
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("__row"))
    return best.select("__row.*")


def first_wins(base: DataFrame, delta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """base and those rows of delta whose key is new; of equal new keys the first by order."""
    names = base.columns
    fresh = delta.join(base.select(*keys), keys, "left_anti")
    return base.unionByName(distinct_on(fresh.select(*names), keys, order))


def distinct_on(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by order (then by all columns)."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*[F.col(o) if isinstance(o, str) else o for o in order], *df.columns)).alias("__row"))
    return best.select("__row.*")


def without(base: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(tombstones.select(*keys), keys, "left_anti")


def since(df: DataFrame, version: str, last: int, upto: int | None = None, full: bool = False) -> DataFrame:
    """Rows after a watermark and not after the next one, which is taken before the scan; full starts at 0."""
    rows = df.where(F.col(version) > (0 if full else last))
    return rows if upto is None else rows.where(F.col(version) <= upto)


def next_watermark(df: DataFrame, version: str) -> int:
    return df.agg(F.max(version)).first()[0] or 0


def append(base: DataFrame, delta: DataFrame) -> DataFrame:
    """Plain append: duplicates stay."""
    return base.unionByName(delta.select(*base.columns))


def blank_to_null(df: DataFrame) -> DataFrame:
    """Empty strings as nulls, as bulk text loads read them."""
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def valid_at(df: DataFrame, start: str, end: str, now) -> DataFrame:
    """Rows whose half-open interval holds an instant."""
    return df.where((F.col(start) <= now) & (F.lit(now) < F.col(end)))
