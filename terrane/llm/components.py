"""Connected components by alternating large-star and small-star steps, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    Each round makes every node point at the smallest of its neighbours and
    ends when the edges are stars. A round's edges are written to the shared
    folder and those of the round before dropped, so lineage and disk stay
    short. A hub of any size is an aggregate (with partial sums) and a join,
    never one task's group. Edges with a null end and loops are ignored; no edges
    give no rows.
    """
    scratch = Scratch(edges.sparkSession, "components")
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    e = scratch.keep(e.select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")).where("hi > lo").distinct(), "0")
    mark, k = _mark(e), 0
    while mark[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b > m").select(F.col("b").alias("hi"), F.col("m").alias("lo"))
        e = scratch.keep(moved.unionAll(small.select(F.col("a").alias("hi"), F.col("m").alias("lo"))).distinct(), str(k + 1))
        scratch.drop(str(k))
        before, mark, k = mark, _mark(e), k + 1
        if before == mark:
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def _mark(e: DataFrame) -> tuple:
    row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
    return tuple(row)
