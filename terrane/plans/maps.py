"""Maps of places: a common view, paths of all kinds of places, SVG documents and their JSON form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import slug

# Corners of a point's circle, its diameter in pixels, metres of a degree of latitude and of the equator.
CORNERS, DIAMETER, DEGREE, EQUATOR = 16, 10.0, 111320.0, 40075000.0


def views(places: DataFrame, width: int, height: int) -> DataFrame:
    """(map, centre_lat, centre_lon, ratio): the middle of each map's box, and the pixels of a metre that just fit it in."""
    p = places.select("map", F.explode(F.flatten("rings")).alias("p")).groupBy("map").agg(*[f(F.col(f"p.{c}")).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in ("lat", "lon")])
    p = p.withColumns({"centre_lat": (F.col("high_lat") + F.col("low_lat")) / 2, "centre_lon": (F.col("high_lon") + F.col("low_lon")) / 2})
    across = F.radians(F.col("high_lon") - F.col("low_lon")) * geo.EARTH * F.cos(F.radians("centre_lat"))
    down = F.radians(F.col("high_lat") - F.col("low_lat")) * geo.EARTH
    return p.select("map", "centre_lat", "centre_lon", F.coalesce(F.least(F.try_divide(F.lit(float(width)), across), F.try_divide(F.lit(float(height)), down)), F.lit(1.0)).alias("ratio"))


def circle(lat, lon, ratio) -> Column:
    """The corners of a point's circle, closed, DIAMETER pixels wide."""
    metres = F.lit(DIAMETER) / ratio
    high, wide = metres / DEGREE, metres / (F.lit(EQUATOR) * F.cos(F.radians(lat)) / 360)
    at = lambda i: F.struct((lat + high / 2 * math.sin(2 * math.pi * i / CORNERS)).alias("lat"), (lon + wide / 2 * math.cos(2 * math.pi * i / CORNERS)).alias("lon"))
    return F.array(*[at(i % CORNERS) for i in range(CORNERS + 1)])


def place_path(kind, rings, centre_lat, centre_lon, ratio, width: int, height: int) -> Column:
    """The path of a point (a circle), a line or a polygon; each ring is a part of its own."""

    def corner(p):
        x, y = geo.to_screen(p["lat"], p["lon"], centre_lat, centre_lon, ratio, width, height)
        return F.format_string("%.2f,%.2f", x, y)

    part = lambda r: F.concat(F.lit("M"), F.array_join(F.transform(r, corner), "L"))
    first = rings[0][0]
    closed = lambda rs: F.array_join(F.transform(rs, lambda r: F.concat(part(r), F.lit("Z"))), "")
    return F.when(kind == "point", closed(F.array(circle(first["lat"], first["lon"], ratio)))).when(kind == "line", F.array_join(F.transform(rings, part), " ")).otherwise(closed(rings))


def map_paths(places: DataFrame, width: int, height: int) -> DataFrame:
    """(map, key, title, path) of places (map, id, title, kind, rings): one row for each title's slug, paths in order of id. Places without points have no path."""
    drawn = places.where("size(flatten(rings)) > 0").join(views(places, width, height), "map")
    drawn = drawn.withColumn("path", place_path(F.col("kind"), F.col("rings"), F.col("centre_lat"), F.col("centre_lon"), F.col("ratio"), width, height)).withColumn("title", F.coalesce("title", F.lit("")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "path"))), lambda x: x["path"]), " ")
    return drawn.groupBy("map", slug(F.col("title")).alias("key")).agg(F.min_by("title", "id").alias("title"), joined.alias("path"))


def _escaped(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")


def svg_documents(places: DataFrame, width: int, height: int) -> DataFrame:
    """(map, svg): a document for each map with a path and its title for each name. A map's paths meet in one row, as the document does."""
    one = F.concat(F.lit('<path d="'), F.col("path"), F.lit('">\n<title>'), _escaped(F.col("title")), F.lit("</title>\n</path>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", one.alias("one")))), lambda x: x["one"]), "\n")
    return map_paths(places, width, height).groupBy("map").agg(F.concat(F.lit(f'<svg width="{width}" height="{height}">\n'), body, F.lit("\n</svg>")).alias("svg"))


def map_documents(places: DataFrame, width: int, height: int) -> DataFrame:
    """(map, json): the same as one JSON object: width, height and items of key, title and path."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("key", "title", "path"))), lambda x: x)
    by = map_paths(places, width, height).groupBy("map").agg(items.alias("items"))
    return by.select("map", F.to_json(F.struct(F.lit(width).alias("width"), F.lit(height).alias("height"), "items")).alias("json"))
