"""Parent-pointer hierarchies: closure, full titles, children, roots and leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def full_titles(objects: DataFrame, id_col: str, parent_col: str, title_col: str, depth: int = 12, separator: str = ", ") -> DataFrame:
    """objects with `full_title`, the titles from the root down, and `levels`, how many they are.

    Pointer doubling: after k rounds a row holds the titles of 2**k ancestors and
    the pointer past them, so a chain of length d takes log2(d) joins, all on
    the same key. A chain that comes back to itself ends at `depth` titles.
    """
    rows = objects.select(F.col(id_col).alias("__id"), F.col(parent_col).alias("__up"), F.array(F.col(title_col)).alias("__titles"))
    rounds = max(1, (depth - 1).bit_length())
    for _ in range(rounds):
        up = rows.select(F.col("__id").alias("__pid"), F.col("__up").alias("__pup"), F.col("__titles").alias("__ptitles"))
        rows = rows.join(up, rows["__up"] == up["__pid"], "left").select(
            "__id", F.col("__pup").alias("__up"), F.concat(F.coalesce("__ptitles", F.array().cast("array<string>")), "__titles").alias("__titles")
        )
    named = rows.select("__id", F.concat_ws(separator, "__titles").alias("full_title"), F.size("__titles").alias("levels"))
    return objects.join(named, objects[id_col] == named["__id"]).drop("__id")


def ancestors(objects: DataFrame, start: DataFrame, id_col: str, parent_col: str, depth: int = 12) -> DataFrame:
    """(start_id, level, id) of the chain from each start row up to its root; level 0 is the start itself."""
    pairs = objects.select(F.col(id_col).alias("__id"), F.col(parent_col).alias("__up"))
    step = start.select(F.col(id_col).alias("start_id"), F.col(id_col).alias("id"), F.lit(0).alias("level"))
    out = step
    for level in range(1, depth):
        step = step.join(pairs, step["id"] == pairs["__id"]).where("__up is not null").select("start_id", F.col("__up").alias("id"), F.lit(level).alias("level"))
        out = out.unionByName(step)
    return out


def descendants(edges: DataFrame, start: DataFrame, parent_col: str, child_col: str, levels: int) -> DataFrame:
    """(id, level) reached from start in at most `levels` steps, each id at its first level; edges: parent, child."""
    step = start.select(F.col(start.columns[0]).alias("id"), F.lit(0).alias("level"))
    out = step
    for level in range(1, levels + 1):
        step = step.join(edges, step["id"] == edges[parent_col]).select(F.col(child_col).alias("id"), F.lit(level).alias("level")).distinct()
        out = out.unionByName(step)
    return out.groupBy("id").agg(F.min("level").alias("level"))


def children(objects: DataFrame, parent_col: str, parent) -> DataFrame:
    return objects.where(F.col(parent_col) == parent)


def roots(objects: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """Objects whose parent is null or not there."""
    up = objects.select(F.col(id_col).alias("__pid"))
    return objects.join(up, objects[parent_col] == up["__pid"], "left_anti")


def leaves(objects: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """Objects that are nobody's parent."""
    up = objects.select(F.col(parent_col).alias("__pid")).where("__pid is not null")
    return objects.join(up, objects[id_col] == up["__pid"], "left_anti")
