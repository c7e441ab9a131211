"""Shapes as text: SVG paths, GeoJSON, packed strings; hulls and simplified lines."""

from __future__ import annotations

import base64
import gzip
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions import geo
from ..functions.text import slug

cloudpickle.register_pickle_by_value(sys.modules[__name__])

POINTS = ArrayType(StructType([StructField("lat", DoubleType()), StructField("lon", DoubleType())]))


def svg_path(points, closed: bool = False) -> Column:
    """'M x y L x y …' of an array of (x, y) structs, with Z if closed."""
    body = F.array_join(F.transform(points, lambda p: F.concat(F.format_string("%.2f", p["x"]), F.lit(" "), F.format_string("%.2f", p["y"]))), " L")
    return F.concat(F.lit("M"), body, F.lit(" Z" if closed else ""))


def title_groups(rows: DataFrame, title: str, path: str, box: list[str], order: list[str]) -> DataFrame:
    """Paths, joined in order, and the common box of rows whose titles have the same slug."""
    left, top, right, bottom = box
    by = rows.groupBy(slug(F.col(title)).alias("key"))
    return by.agg(
        F.min_by(title, F.struct(*order)).alias("title"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, path))), lambda x: x[path]), " ").alias("path"),
        F.floor(F.min(left)).alias("left"), F.floor(F.min(top)).alias("top"), F.ceil(F.max(right)).alias("right"), F.ceil(F.max(bottom)).alias("bottom"),
    )


def geojson_line(points, properties) -> Column:
    """A LineString feature of an array of (lat, lon) structs."""
    coordinates = F.transform(points, lambda p: F.array(p["lon"], p["lat"]))
    geometry = F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")))


def geojson_polygon(rings, properties) -> Column:
    coordinates = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["lon"], p["lat"])))
    geometry = F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")))


def geojson_collection(features: DataFrame, feature: str, by: list[str], order: list[str]) -> DataFrame:
    """One FeatureCollection per group, features in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, feature))), lambda x: x[feature]), ",")
    return features.groupBy(*by).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), joined, F.lit("]}")).alias("geojson"))


def route_shape(edges: DataFrame) -> DataFrame:
    """(route, shape, distance) of a route's edges (route, k, forward, shape) in order, each turned its way, common ends once."""
    turned = edges.withColumn("part", F.when(F.col("forward"), F.col("shape")).otherwise(F.reverse("shape")))
    parts = turned.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("k", "part"))).alias("p"))
    shape = F.aggregate(F.transform("p", lambda x: x["part"]), F.slice(F.element_at("p", 1)["part"], 1, 1), lambda acc, part: F.concat(acc, F.slice(part, 2, F.greatest(F.size(part) - 1, F.lit(0)))))
    return parts.select("route", shape.alias("shape")).withColumn("distance", geo.line_length(F.col("shape")))


def route_geojson(edges: DataFrame, stops: DataFrame | None = None) -> DataFrame:
    """(route, geojson): one FeatureCollection a route, a line for each edge and then a point for each stop.

    edges: route, k, forward, shape, attributes; stops: route, k, shape_index,
    lat, lon, attributes. Edges of fewer than two points have no line. A route's
    features meet in one row, which its length bounds.
    """
    bag = F.coalesce(F.col("attributes"), F.create_map().cast("map<string,string>")).alias("properties")
    part = F.when(F.col("forward"), F.col("shape")).otherwise(F.reverse("shape"))
    line = F.struct(F.lit("LineString").alias("type"), F.transform(part, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")).alias("geometry")
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.lit("ShapeMeta").alias("name"), line, bag)).alias("feature")
    rows = edges.where(F.size("shape") > 1).select("route", F.lit(0).alias("part"), "k", feature)
    if stops is not None:
        point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry")
        index = F.col("shape_index").cast("string").alias("Shape")
        stop = F.to_json(F.struct(F.lit("Feature").alias("type"), F.lit("Stop").alias("name"), index, point, bag)).alias("feature")
        rows = rows.unionByName(stops.select("route", F.lit(1).alias("part"), "k", stop))
    return geojson_collection(rows, "feature", ["route"], ["part", "k"])


@F.pandas_udf(StringType())
def pack(s: pd.Series) -> pd.Series:
    """gzip and base64; the same text gives the same string."""
    return s.map(lambda x: None if x is None else base64.b64encode(gzip.compress(x.encode(), mtime=0)).decode())


@F.pandas_udf(StringType())
def unpack(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else gzip.decompress(base64.b64decode(x)).decode())


@F.pandas_udf(POINTS)
def hull(points: pd.Series) -> pd.Series:
    """The closed convex hull of each row's points, anticlockwise from the westernmost."""

    def one(row):
        p = sorted({(q["lon"], q["lat"]) for q in row})
        if len(p) > 2:
            halves = []
            for seq in (p, p[::-1]):
                h: list = []
                for q in seq:
                    while len(h) > 1 and (h[-1][0] - h[-2][0]) * (q[1] - h[-2][1]) - (h[-1][1] - h[-2][1]) * (q[0] - h[-2][0]) <= 0:
                        h.pop()
                    h.append(q)
                halves += h[:-1]
            p = halves
        return [{"lat": y, "lon": x} for x, y in [*p, *p[:1]]]

    return points.map(lambda row: None if row is None else one(row))


def simplify(metres: float):
    """A pandas UDF: lines of (lat, lon) with points left out that lie within `metres` of the line without them."""
    import math

    @F.pandas_udf(POINTS)
    def run(lines: pd.Series) -> pd.Series:
        def away(p, a, b):
            k = math.cos(math.radians(a["lat"]))
            dx, dy, px, py = (b["lon"] - a["lon"]) * k, b["lat"] - a["lat"], (p["lon"] - a["lon"]) * k, p["lat"] - a["lat"]
            t = max(0.0, min(1.0, (px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            return math.radians(math.hypot(px - t * dx, py - t * dy)) * 6371000.0

        def one(row):
            keep, todo = {0, len(row) - 1}, [(0, len(row) - 1)]
            while todo:
                i, j = todo.pop()
                far = max(((away(row[k], row[i], row[j]), k) for k in range(i + 1, j)), default=(0.0, 0))
                if far[0] > metres:
                    keep.add(far[1])
                    todo += [(i, far[1]), (far[1], j)]
            return [dict(lat=row[k]["lat"], lon=row[k]["lon"]) for k in sorted(keep)]

        return lines.map(lambda row: None if row is None else one(list(row)) if len(row) else [])

    return run
