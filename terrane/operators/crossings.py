"""Where lines and outlines of two tables cross: a join of their segments over grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .cells import cell, on_cells, segments_of


def _segments(df: DataFrame, prefix: str, size: float) -> DataFrame:
    """Segments on cells of rows (id, shape, closed), as a start and a step, columns prefixed; dealt by cell.

    The numbers of partitions are given, so they are not merged by their bytes: what a
    partition costs are its cells and its pairs, which grow with the product of both sides.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = [segments_of(df.where("closed" if closed else "not closed"), "shape", closed, ["id"]) for closed in (True, False)]
    s = parts[0].unionByName(parts[1]).where("y1 is not null and x1 is not null and y2 is not null and x2 is not null")
    s = on_cells(s.repartition(n), size)
    s = s.withColumns({"y": F.col("y1"), "x": F.col("x1"), "dy": F.col("y2") - F.col("y1"), "dx": F.col("x2") - F.col("x1")})
    s = s.select("cy", "cx", *[F.col(c).alias(f"{prefix}{c}") for c in ("id", "seg", "y", "x", "dy", "dx")])
    return s.repartition(n, "cy", "cx")


def crossings(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """(a, b, a_seg, b_seg, lat, lon): each crossing of a segment of a with one of b; rows are (id, shape, closed), closed ones are outlines.

    Segments meet in the cells that both run through. A pair belongs to the cell
    that its crossing lies in, so it comes out once without a distinct. Parallel
    segments do not cross; ends count. Empty tables and shapes of fewer than two points have no rows.

    The join's own condition is a few products; places along the segments are
    divided out behind it, for the pairs that it lets through. The generator keeps the optimizer from
    putting them, several times each, into the condition, whose code is then too long to be compiled.
    """
    met = _segments(a, "a_", size).join(_segments(b, "b_", size), ["cy", "cx"])
    whole, t, u = geo.crossing_parts(*[F.col(f"{p}{c}") for p in ("a_", "b_") for c in ("y", "x", "dy", "dx")])
    both = met.where(geo.may_be_share(t, whole) & geo.may_be_share(u, whole))
    at = both.select("*", F.inline(F.array(F.struct(F.try_divide(t, whole).alias("t"), F.try_divide(u, whole).alias("u")))))
    lat, lon = F.col("a_y") + F.col("t") * F.col("a_dy"), F.col("a_x") + F.col("t") * F.col("a_dx")
    own = at.where(F.col("t").between(0, 1) & F.col("u").between(0, 1) & (cell(lat, size) == F.col("cy")) & (cell(lon, size) == F.col("cx")))
    return own.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "a_seg", "b_seg", lat.alias("lat"), lon.alias("lon"))
