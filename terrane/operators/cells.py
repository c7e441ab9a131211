"""Segments on a grid: the cells that each one runs through, and the rows of cells that it crosses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Degrees by which a piece of a segment is widened before its cells are taken, so that rounding loses none.
WIDER = 1e-9


def steps(shape: Column, closed: bool) -> Column:
    """(i, a, b) of consecutive points of an array; closed adds the step from the last to the first."""
    after = F.concat(F.slice(shape, 2, F.greatest(F.size(shape) - 1, F.lit(0))), F.slice(shape, 1, 1 if closed else 0))
    pairs = F.zip_with(F.slice(shape, 1, F.size(shape) if closed else F.greatest(F.size(shape) - 1, F.lit(0))), after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.transform(pairs, lambda p, i: F.struct(i.alias("i"), p["a"].alias("a"), p["b"].alias("b")))


def segments_of(df: DataFrame, shape: str, closed: bool, keep: list[str]) -> DataFrame:
    """(keep, seg, y1, x1, y2, x2) of the points in a column, by number."""
    s = df.select(*keep, F.explode(steps(F.col(shape), closed)).alias("s"))
    return s.select(*keep, F.col("s.i").alias("seg"), F.col("s.a.lat").alias("y1"), F.col("s.a.lon").alias("x1"), F.col("s.b.lat").alias("y2"), F.col("s.b.lon").alias("x2"))


def cell(value, size: float) -> Column:
    return F.floor(value / size).cast("int")


def on_cells(segments: DataFrame, size: float) -> DataFrame:
    """segments (y1, x1, y2, x2) with cy, cx: a row for each cell that one runs through.

    A segment is cut into pieces no longer than a cell, which touch four cells at most,
    so a long one takes cells by its length and not by its box.
    """
    n = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("y2") - F.col("y1")), F.abs(F.col("x2") - F.col("x1"))) / size)).cast("int")
    at = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * t

    def of(i):
        t, u = i / n, (i + 1) / n
        span = lambda a, b: F.sequence(cell(F.least(at(a, b, t), at(a, b, u)) - WIDER, size), cell(F.greatest(at(a, b, t), at(a, b, u)) + WIDER, size))
        return F.flatten(F.transform(span("y1", "y2"), lambda y: F.transform(span("x1", "x2"), lambda x: F.struct(y.alias("cy"), x.alias("cx")))))

    cells = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), of)))
    return segments.withColumn("__c", F.explode(cells)).withColumns({"cy": F.col("__c.cy"), "cx": F.col("__c.cx")}).drop("__c")
