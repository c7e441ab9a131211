"""Spatial joins over a grid, and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def cell_of(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("int")


def cells_of_box(south, west, north, east, size: float) -> Column:
    """All (row, column) cells that a box touches."""
    rows, cols = F.sequence(cell_of(south, size), cell_of(north, size)), F.sequence(cell_of(west, size), cell_of(east, size))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(r.alias("cy"), c.alias("cx")))))


def within_boxes(points: DataFrame, areas: DataFrame, lat: str, lon: str, size: float, exact: Column | None = None) -> DataFrame:
    """points joined to the areas (columns south, west, north, east) whose box holds them, exact adding a finer test.

    Areas are cut into grid cells; points meet them by an equi-join on the cell,
    so neither side is compared with all of the other. A point has one cell, so
    no pair is found twice. AQE splits a cell that many points share.
    """
    cut = areas.withColumn("__cell", F.explode(cells_of_box(F.col("south"), F.col("west"), F.col("north"), F.col("east"), size)))
    at = points.withColumn("__cell_p", F.struct(cell_of(F.col(lat), size).alias("cy"), cell_of(F.col(lon), size).alias("cx")))
    hit = at.join(cut, at["__cell_p"] == cut["__cell"]).where(geo.in_box(F.col(lat), F.col(lon), F.col("south"), F.col("west"), F.col("north"), F.col("east")))
    return (hit if exact is None else hit.where(exact)).drop("__cell", "__cell_p")


def within_rings_over_date_line(points: DataFrame, areas: DataFrame, lat: str, lon: str, size: float) -> DataFrame:
    """points joined to the areas (column rings) that hold them; areas over the date line are taken from 0 to 360, and so are the points that meet them.

    Points meet the cells of the areas' boxes by an equi-join; only points in a box are tested against the rings.
    """
    flat = lambda c: F.transform(F.flatten("__rings"), lambda p: p[c])
    wider = 1e-9  # what rounding may put on the edge of a box
    box = {"south": F.array_min(flat("lat")) - wider, "west": F.array_min(flat("lon")) - wider, "north": F.array_max(flat("lat")) + wider, "east": F.array_max(flat("lon")) + wider}

    def hits(over: bool) -> DataFrame:
        rings, x = F.col("rings"), geo.shift_longitude(F.col(lon)) if over else F.col(lon)
        some = areas.where(geo.over_date_line(rings) == over).withColumn("__rings", geo.shift_rings(rings) if over else rings).withColumns(box)
        met = within_boxes(points.withColumns({"__lat": F.col(lat).cast("double"), "__lon": x.cast("double")}), some, "__lat", "__lon", size, geo.in_rings(F.col("__lat"), F.col("__lon"), F.col("__rings")))
        return met.drop("__lat", "__lon", "__rings", *box)

    return hits(False).unionByName(hits(True))


def nearest(df: DataFrame, lat: str, lon: str, at_lat: float, at_lon: float, k: int, tie: str, planar: bool = False, name: str = "distance") -> DataFrame:
    """The k rows nearest to a point: metres on the sphere, or degrees in the plane. A top-k per partition, then one of those."""
    a, b = F.lit(float(at_lat)), F.lit(float(at_lon))
    d = F.sqrt(geo.planar2(F.col(lat), F.col(lon), a, b)) if planar else geo.haversine(F.col(lat), F.col(lon), a, b)
    return df.withColumn(name, d).orderBy(name, tie).limit(k)
