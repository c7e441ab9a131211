"""What lies in which area: areas as grid cells, where only cells that a ring runs through are tested, against the edges in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import cell, on_cells, segments_of
from .rounds import Rounds

#: The place in a cell that is known to be inside or outside, as parts of its size; corners of real shapes seldom fall on these.
REF_Y, REF_X = 0.4637218, 0.5361947


class AreaCells:
    """Areas (area, rings) on a grid, under the even-odd rule: holes are rings like others.

    edges: (area, cy, cx, seg, y1, x1, y2, x2) has each ring's edges once for each cell that
    they run through. cover: (area, cy, cx, inside, tested) has a row for each cell of an
    area: tested if an edge is in it; inside says where the cell's reference place is. No row holds a
    whole ring. The inside of a row of cells is filled between crossings of a line through
    the references, so the cost is that of the outline and of the cells it encloses.
    """

    def __init__(self, areas: DataFrame, size: float, name: str = "areas"):
        self.size, self.rounds = size, Rounds(areas.sparkSession, name)
        rings = areas.select("area", F.posexplode("rings").alias("ring", "shape"))
        segments = segments_of(rings, "shape", True, ["area", "ring"]).where("y1 is not null and x1 is not null and y2 is not null and x2 is not null and (y1 <> y2 or x1 <> x2)")
        self.edges = self.rounds.keep(on_cells(segments, size).select("area", "cy", "cx", F.struct("ring", "seg").alias("seg"), "y1", "x1", "y2", "x2"), "edges")
        lower, upper = F.least("y1", "y2"), F.greatest("y1", "y2")
        row = F.explode(F.filter(F.sequence(cell(lower, size) - 1, cell(upper, size) + 1), lambda r: (lower <= (r + REF_Y) * size) & (upper > (r + REF_Y) * size)))
        y = (F.col("cy") + REF_Y) * size
        crossed = segments.withColumn("cy", row).select("area", "cy", ((y - F.col("y1")) * ((F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))) + F.col("x1")).alias("x"))
        runs = crossed.groupBy("area", "cy").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # the crossings of one outline by one row
        pair = F.explode(F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda i: F.struct(F.get("xs", 2 * i).alias("a"), F.get("xs", 2 * i + 1).alias("b"))))
        runs = runs.where("size(xs) > 1").select("area", "cy", pair.alias("r")).select("area", "cy", F.ceil(F.col("r.a") / size - REF_X).cast("int").alias("first"), (F.ceil(F.col("r.b") / size - REF_X) - 1).cast("int").alias("last"))
        filled = runs.where("first <= last").select("area", "cy", F.explode(F.sequence("first", "last")).alias("cx")).withColumns({"inside": F.lit(True), "tested": F.lit(False)})
        touched = self.edges.select("area", "cy", "cx").distinct().withColumns({"inside": F.lit(False), "tested": F.lit(True)})
        self.cover = self.rounds.keep(filled.unionByName(touched).groupBy("area", "cy", "cx").agg(F.max("inside").alias("inside"), F.max("tested").alias("tested")), "cover")

    def holding(self, points: DataFrame) -> DataFrame:
        """(points, area) of the points (lat, lon and other columns, each row with a key of its own) and the areas that hold them.

        A point of an untested cell is in or out as its cell is. For others the way from the
        cell's reference to the point, first along its meridian, then along its parallel, is crossed by the edges
        of that cell alone.
        """
        at = points.withColumns({"cy": cell(F.col("lat"), self.size), "cx": cell(F.col("lon"), self.size)})
        hit = at.join(self.cover, ["cy", "cx"])
        sure = hit.where("inside and not tested").drop("cy", "cx", "inside", "tested")
        e = self.edges.select("area", "cy", "cx", "y1", "x1", "y2", "x2")
        ry, rx = (F.col("cy") + REF_Y) * self.size, (F.col("cx") + REF_X) * self.size
        north = ((F.col("x1") > rx) != (F.col("x2") > rx)) & _between(ry, F.col("lat"), (rx - F.col("x1")) * F.try_divide(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")) + F.col("y1"))
        east = ((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & _between(rx, F.col("lon"), (F.col("lat") - F.col("y1")) * F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) + F.col("x1"))
        times = F.coalesce(north, F.lit(False)).cast("int") + F.coalesce(east, F.lit(False)).cast("int")
        asked = hit.where("tested").join(e, ["area", "cy", "cx"]).groupBy(*points.columns, "area", "inside").agg(F.sum(times).alias("times"))
        tested = asked.where(F.col("inside") == (F.col("times") % 2 == 0)).drop("inside", "times")
        return sure.select(*points.columns, "area").unionByName(tested.select(*points.columns, "area"))

    def crossing(self, segments: DataFrame) -> DataFrame:
        """(id, area) of segments (id, y1, x1, y2, x2) that an edge of an area properly crosses: each has ends on both sides of the other."""
        s = on_cells(segments.select("id", *[F.col(c).alias(f"s{c}") for c in ("y1", "x1", "y2", "x2")], "y1", "x1", "y2", "x2"), self.size).drop("y1", "x1", "y2", "x2")
        met = s.join(self.edges, ["cy", "cx"])
        side = lambda ay, ax, by, bx, py, px: F.signum((F.col(bx) - F.col(ax)) * (F.col(py) - F.col(ay)) - (F.col(by) - F.col(ay)) * (F.col(px) - F.col(ax)))
        own, other = ("sy1", "sx1", "sy2", "sx2"), ("y1", "x1", "y2", "x2")
        apart = (side(*own, "y1", "x1") * side(*own, "y2", "x2") < 0) & (side(*other, "sy1", "sx1") * side(*other, "sy2", "sx2") < 0)
        return met.where(apart).select("id", "area").distinct()


def _between(ref: Column, to: Column, x: Column) -> Column:
    """Whether a crossing at x lies between the reference and a place; a place on the edge counts to the side of smaller numbers, as in the ray test."""
    return (ref < x) != (to < x)


def within(places: DataFrame, areas: DataFrame, size: float) -> DataFrame:
    """(id, area) of places (id, kind, rings) that lie wholly in areas (area, rings): points, lines, polygons.

    All points of the place must be inside, no edge of it may cross an edge of the area, and, for a polygon,
    no ring of the area may begin inside it (a hole would). Points meet areas by
    cells; edges meet edges by cells. Places without points are in nothing; rows of one id are one place.
    """
    grid = AreaCells(areas, size)
    rings = places.select("id", F.col("kind") == "polygon", F.posexplode("rings").alias("ring", "shape")).toDF("id", "closed", "ring", "shape")
    corners = rings.select("id", F.explode("shape").alias("p")).select("id", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon")).where("lat is not null and lon is not null").distinct()
    size_of = corners.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    inside = grid.holding(corners).groupBy("id", "area").agg(F.count(F.lit(1)).alias("held")).join(size_of, "id").where("held = n").select("id", "area")
    inside = grid.rounds.keep(inside, "inside")
    some = rings.join(inside.select("id").distinct(), "id", "left_semi")
    steps = segments_of(some.where("closed"), "shape", True, ["id"]).unionByName(segments_of(some.where("not closed"), "shape", False, ["id"])).where("y1 is not null and y2 is not null")
    out = inside.join(grid.crossing(steps), ["id", "area"], "left_anti")
    shapes = places.where("kind = 'polygon'").join(inside.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("area"), "rings")
    begins = areas.select(F.col("area").alias("__area"), F.explode("rings").alias("r")).select("__area", F.element_at("r", 1).alias("p")).select("__area", F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon")).where("lat is not null").distinct()
    holes = AreaCells(shapes, size, "shapes").holding(begins).select(F.col("area").alias("id"), F.col("__area").alias("area")).distinct()
    return out.join(holes, ["id", "area"], "left_anti")
