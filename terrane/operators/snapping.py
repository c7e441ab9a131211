"""Nearest lines of many points at once: a join over grid cells, wider from round to round until a bound proves the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .cells import cell, on_cells, segments_of
from .rounds import Rounds

#: Cells on each side of a point's own that a round looks at.
REACH = 2
#: Degrees under which two distances count as equal; of equals the smaller id is nearer.
DIGITS = 9
#: Directions of edges that a point may be put on (fixed values): both ways, along, against.
OPEN = (0, 1, 2)


def nearest_lines(points: DataFrame, lines: DataFrame, size: float, k: int = 1, rounds_most: int = 40) -> DataFrame:
    """(id, line, distance, lat, lon, seg, y1, x1, y2, x2): for each point (id, lat, lon) the k nearest lines (line, shape) in the plane of degrees, and the place on them.

    Round j looks at cells of size * 2**j around the point. What it does not see is at
    least REACH such cells away, so a point whose k-th distance is under that is done; the
    others go on with cells twice as large. A cell is only opened if it begins
    nearer than the k-th line found and, for k = 1, than the far corner of another cell with lines. Points
    and lines meet by equi-joins on cells; no point is compared with all lines. For k = 1 they meet
    twice, first for each point's least distance, then for the place at it, so pairs are neither sorted nor gathered. Points without a place are
    left out, and so are lines of fewer than two points; without lines there are no rows.
    """
    rounds = Rounds(points.sparkSession, "snap")
    segments = segments_of(lines, "shape", False, ["line"]).where("y1 is not null and x1 is not null and y2 is not null and x2 is not null")
    base = rounds.keep(on_cells(segments, size), "cells")
    extent = base.agg(F.min("cy"), F.max("cy"), F.min("cx"), F.max("cx")).first()
    left = rounds.keep(points.select("id", "lat", "lon").where("lat is not null and lon is not null").withColumn("far", F.lit(None).cast("double")), "left")
    best = None
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = F.round(F.sqrt(geo.planar2(F.col("p.lat"), F.col("p.lon"), F.col("lat"), F.col("lon"))), DIGITS)

    def met_by(taken: DataFrame, level: DataFrame) -> DataFrame:
        # the number of partitions is given, so they are not merged by their bytes: their cost are the pairs
        both = taken.repartition(parts, "cy", "cx").join(level.repartition(parts, "cy", "cx"), ["cy", "cx"])
        return both.withColumn("p", geo.closest_on_segment(F.col("lat"), F.col("lon"), F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2")))

    for j in range(rounds_most if extent[0] is not None else 0):
        wide, last = size * 2**j, False
        level = base.withColumns({"cy": F.shiftright("cy", j), "cx": F.shiftright("cx", j)})
        near = F.sequence(F.lit(-REACH), F.lit(REACH))
        block = F.flatten(F.transform(near, lambda y: F.transform(near, lambda x: F.struct((cell(F.col("lat"), wide) + y).alias("cy"), (cell(F.col("lon"), wide) + x).alias("cx")))))  # noqa: B023
        at = left.withColumn("c", F.explode(block)).select("id", "lat", "lon", "far", F.col("c.cy").alias("cy"), F.col("c.cx").alias("cx"))
        gap = lambda v, c: F.greatest(F.col(c) * wide - F.col(v), F.col(v) - (F.col(c) + 1) * wide, F.lit(0.0))  # noqa: B023, E731
        reach = lambda v, c: F.greatest(F.abs(F.col(c) * wide - F.col(v)), F.abs((F.col(c) + 1) * wide - F.col(v)))  # noqa: B023, E731
        at = at.withColumns({"begins": F.hypot(gap("lat", "cy"), gap("lon", "cx")), "ends": F.hypot(reach("lat", "cy"), reach("lon", "cx"))}).where("far is null or begins <= far + 1e-9")
        taken = at.join(level.select("cy", "cx").distinct(), ["cy", "cx"])
        if k == 1:
            first = taken.groupBy("id").agg(F.min("ends").alias("within"))
            taken = taken.join(first, "id").where("begins <= within + 1e-9").drop("within")
            taken = rounds.keep(taken, "taken")
            least = met_by(taken, level).groupBy("id").agg(F.min(d).alias("least"))  # numbers alone: a hash aggregate, which holds points and not pairs
            taken = taken.join(rounds.keep(least, "least"), "id").where("begins <= least + 1e-8")
        met = met_by(taken, level)
        if k == 1:
            met = met.where(d <= F.col("least"))
        met = met.select("id", "line", F.struct(d.alias("distance"), "seg", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"), "y1", "x1", "y2", "x2").alias("s"))
        one = met.groupBy("id", "line").agg(F.min("s").alias("s"))
        if best is not None:
            one = one.unionByName(best.join(left.select("id"), "id", "left_semi")).groupBy("id", "line").agg(F.min("s").alias("s"))
        top = one.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.col("s.distance").alias("distance"), "line", "s"))), 1, k).alias("top"))
        found = rounds.keep(top.select("id", F.explode("top").alias("t")).select("id", "t.line", "t.s"), f"found{j}")
        best = found if best is None else best.join(found.select("id").distinct(), "id", "left_anti").unionByName(found)
        best = rounds.keep(best, "best")
        edge = [F.col("lat") - F.floor(F.col("lat") / wide) * wide, F.col("lon") - F.floor(F.col("lon") / wide) * wide]
        safe = REACH * wide + F.least(*edge, *[wide - e for e in edge])  # all that was not seen is further
        reached = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("s.distance").alias("worst"))
        seen_all = (cell(F.col("lat"), wide) - REACH <= (extent[0] >> j)) & (cell(F.col("lat"), wide) + REACH >= (extent[1] >> j)) & (cell(F.col("lon"), wide) - REACH <= (extent[2] >> j)) & (cell(F.col("lon"), wide) + REACH >= (extent[3] >> j))
        on = left.drop("far").join(reached, "id", "left").where(~(seen_all | ((F.coalesce("n", F.lit(0)) >= k) & (F.col("worst") <= safe))))
        left = rounds.keep(on.select("id", "lat", "lon", F.when(F.col("n") >= k, F.col("worst")).alias("far")), "left")
        rounds.drop(f"found{j}", "taken", "least")
        if left.isEmpty():
            break
    if best is None:
        return points.sparkSession.createDataFrame([], f"id {points.schema['id'].dataType.simpleString()}, line {lines.schema['line'].dataType.simpleString()}, distance double, lat double, lon double, seg int, y1 double, x1 double, y2 double, x2 double")
    return best.select("id", "line", "s.*").select("id", "line", "distance", "lat", "lon", "seg", "y1", "x1", "y2", "x2")


def offset_on(shape, lat, lon, tolerance: float = 1.0):
    """The number of the first point of a shape, from 1, to which the way over (lat, lon) from the point before is under `tolerance` metres longer; 0 if there is none."""
    from .cells import steps

    d = lambda a, la, lo: geo.haversine(a["lat"], a["lon"], la, lo)
    hits = F.filter(steps(shape, False), lambda s: F.abs(d(s["a"], lat, lon) + d(s["b"], lat, lon) - d(s["a"], s["b"]["lat"], s["b"]["lon"])) < tolerance)
    return F.coalesce(F.get(hits, F.lit(0))["i"] + 1, F.lit(0))


def snap(points: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """(id, edge, distance, lat, lon, offset): each point put on the nearest edge (edge, shape, direction, weight) that its profile may use.

    Edges without a weight for the profile, or with another direction than both, along or against, take no points.
    """
    usable = edges.where(F.col("weight").isNotNull() & F.col("direction").isin(*OPEN))
    near = nearest_lines(points, usable.select(F.col("edge").alias("line"), "shape"), size)
    put = near.join(usable.select(F.col("edge").alias("line"), "shape"), "line")
    return put.select("id", F.col("line").alias("edge"), "distance", "lat", "lon", offset_on(F.col("shape"), F.col("lat"), F.col("lon")).alias("offset"))
