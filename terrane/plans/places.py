"""Place geometries from map elements, and their enrichment by the areas that hold them.

A geometry is a struct: kind (point, line, polygon) and rings, arrays of
(lat, lon). A polygon's rings are together under the even-odd rule; those of
relations are unions and differences of their members in order.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, tags as t
from ..functions.polygons import fold
from ..operators import containment
from ..operators.cells import steps

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(sys.modules[fold.__module__])

RING = "array<struct<lat:double,lon:double>>"


def node_places(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Points of the nodes that have any of the keys."""
    some = nodes.where(t.has_any_key(F.col("tags"), keys))
    return some.select("id", "tags", F.lit("point").alias("kind"), F.array(F.array(F.struct("lat", "lon"))).alias("rings"))


def way_places(ways: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Point, line or polygon of each way that has any of the keys.

    Nodes that are not there are skipped. An area (tag area or building) with
    more than two nodes left is a polygon, closed if need be; a way with none
    left has no place.
    """
    some = ways.where(t.has_any_key(F.col("tags"), keys))
    at = some.select("id", F.posexplode("nodes").alias("pos", "node")).join(nodes.select(F.col("id").alias("node"), "lat", "lon"), "node")
    shape = at.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("ring"))
    area = t.has_any_key(F.col("tags"), ["area", "building"])
    closed = F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.col("ring")).otherwise(F.concat("ring", F.slice("ring", 1, 1)))
    kind = F.when(area & (F.size("ring") > 2), "polygon").when(F.size("ring") > 1, "line").otherwise("point")
    out = some.select("id", "tags").join(shape, "id").withColumn("kind", kind)
    return out.select("id", "tags", "kind", F.array(F.when(F.col("kind") == "polygon", closed).otherwise(F.col("ring"))).alias("rings"))


def connect_rings(chains: list[list[int]]) -> list[list[int]]:
    """Closed rings of node ids from chains joined at common ends; what stays open is closed by force."""
    ends: dict[int, list[int]] = {}
    left = {i: list(c) for i, c in enumerate(chains) if c is not None and len(c)}
    for i, c in left.items():
        for e in {c[0], c[-1]}:
            ends.setdefault(e, []).append(i)
    rings = []
    while left:
        i = next(iter(left))
        ring = left.pop(i)
        grown = True
        while ring[0] != ring[-1] and grown:
            grown = False
            for j in ends.get(ring[-1], ()):
                if j in left and left[j][0] != left[j][-1]:
                    c = left.pop(j)
                    ring += c[1:] if c[0] == ring[-1] else c[-2::-1]
                    grown = True
                    break
            else:
                ring.reverse()
                for j in ends.get(ring[-1], ()):
                    if j in left and left[j][0] != left[j][-1]:
                        c = left.pop(j)
                        ring += c[1:] if c[0] == ring[-1] else c[-2::-1]
                        grown = True
                        break
        if ring[0] != ring[-1]:
            ring.append(ring[0])
        rings.append(ring)
    return rings


def relation_places(relations: DataFrame, ways: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Polygons of relations from their way members with roles outer and inner; other roles are ignored.

    Members of one role in a row form a run. Each run's ways are joined to rings; runs are added (outer)
    and taken away (inner) in order, so outers that touch or overlap become one. The rings left stand under the
    even-odd rule, and no two of them cross.
    """
    some = relations.where(t.has_any_key(F.col("tags"), keys))
    m = some.select("id", F.posexplode("members").alias("pos", "m")).where("m.type = 1 and m.role in ('outer', 'inner')").select("id", "pos", F.col("m.role").alias("role"), F.col("m.id").alias("way"))
    w = Window.partitionBy("id").orderBy("pos")  # the members of one relation
    m = m.withColumn("new", F.coalesce((F.col("role") != F.lag("role").over(w)).cast("int"), F.lit(0))).withColumn("run", F.sum("new").over(w)).drop("new")
    chains = m.join(ways.select(F.col("id").alias("way"), "nodes"), "way")
    by_run = chains.groupBy("id", "run", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "nodes"))), lambda c: c["nodes"]).alias("chains"))

    @F.pandas_udf("array<array<bigint>>")
    def rings(c: pd.Series) -> pd.Series:
        return c.map(lambda chains: connect_rings([[int(n) for n in x] for x in chains]))

    @F.pandas_udf(f"array<{RING}>")
    def folded(runs: pd.Series) -> pd.Series:
        read = lambda ring: [(p["lat"], p["lon"]) for p in ring]
        return runs.map(lambda rs: [[{"lat": y, "lon": x} for y, x in ring] for ring in fold([(r["role"], [read(ring) for ring in r["rings"]]) for r in rs])])

    pts = by_run.select("id", "run", "role", F.posexplode(rings("chains")).alias("r", "ring")).select("id", "run", "role", "r", F.posexplode("ring").alias("k", "node"))
    pts = pts.join(nodes.select(F.col("id").alias("node"), "lat", "lon"), "node")
    shape = F.transform(F.array_sort(F.collect_list(F.struct("k", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    ring = pts.groupBy("id", "run", "role", "r").agg(shape.alias("ring")).where("size(ring) >= 4")
    runs = ring.groupBy("id", "run", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "ring"))), lambda x: x["ring"]).alias("rings"))
    out = runs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("run", "role", "rings"))).alias("runs")).select("id", folded("runs").alias("rings")).where("size(rings) > 0")
    return some.select("id", "tags").join(out, "id").select("id", "tags", F.lit("polygon").alias("kind"), "rings")


def with_box(places: DataFrame) -> DataFrame:
    """places with south, west, north, east, and lat, lon of the middle: of a polygon by area of its first ring, of a line by length, of a point itself."""
    flat = F.flatten("rings")
    of = lambda f, c: f(F.transform(flat, lambda p: p[c]))
    ring = F.element_at("rings", 1)
    mean = F.struct(*[(F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[c]) / F.size(ring)).alias(c) for c in ("lat", "lon")])  # noqa: B023
    middle = F.when((F.col("kind") == "polygon") & (F.abs(geo.ring_area(ring)) > 1e-12), area_centroid(ring)).when(F.col("kind") == "line", F.coalesce(line_centroid(ring), mean)).otherwise(mean)
    boxed = places.withColumns({"south": of(F.array_min, "lat"), "west": of(F.array_min, "lon"), "north": of(F.array_max, "lat"), "east": of(F.array_max, "lon"), "__middle": middle})
    return boxed.withColumns({"lat": F.col("__middle.lat"), "lon": F.col("__middle.lon")}).drop("__middle")


def line_centroid(line):
    """(lat, lon) of a line's length-weighted middle in the plane; null where it has no length."""
    pairs = steps(line, False)
    length = lambda s: F.sqrt(geo.planar2(s["a"]["lat"], s["a"]["lon"], s["b"]["lat"], s["b"]["lon"]))
    total = F.aggregate(F.transform(pairs, length), F.lit(0.0), lambda x, y: x + y)
    part = lambda c: F.try_divide(F.aggregate(F.transform(pairs, lambda s: length(s) * (s["a"][c] + s["b"][c]) / 2), F.lit(0.0), lambda x, y: x + y), total)
    return F.when(total > 0, F.struct(part("lat").alias("lat"), part("lon").alias("lon")))


def area_centroid(ring):
    """(lat, lon) of a ring's area-weighted middle."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    cross = lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"]
    total = lambda c: F.aggregate(F.zip_with(ring, after, lambda a, b: (a[c] + b[c]) * cross(a, b)), F.lit(0.0), lambda x, y: x + y)
    area = geo.ring_area(ring)
    return F.struct(F.try_divide(total("lat"), 6 * area).alias("lat"), F.try_divide(total("lon"), 6 * area).alias("lon"))


# Keys whose holders name a place's address. By value: the tag's value is part of the key.
BY_VALUE, BY_VALUE_UNDER_KEY = ("place",), ("highway", "railway")
BY_KEY = ("building", "man_made", "natural", "landuse", "shop", "bridge", "tunnel", "station", "platform")
BY_LEVEL = {"4": "region", "5": "district", "6": "municipality", "8": "subdistrict"}


def derivations(tags) -> Column:
    """(key, value) that an area gives to what it holds: its own addr tags, and its name under keys that its kind says."""
    name, get = t.name_or_ref(tags), lambda k: t.get(tags, k)
    pair = lambda key, when: F.when(when.isNotNull() & name.isNotNull(), F.struct(key.alias("key"), name.alias("value")))
    named = [pair(F.concat(F.lit("addr:"), get(k)), get(k)) for k in BY_VALUE] + [pair(F.concat(F.lit(f"addr:{k}:"), get(k)), get(k)) for k in BY_VALUE_UNDER_KEY] + [pair(F.lit(f"addr:{k}"), get(k)) for k in BY_KEY]
    level = lambda n: F.when((get("type") == "boundary") & (get("admin_level") == n), F.lit(n))
    named += [pair(F.lit(f"addr:{k}"), level(n)) for n, k in BY_LEVEL.items()]
    own = F.filter(F.map_entries(tags), lambda e: e["key"].startswith("addr"))
    return F.concat(F.coalesce(own, F.array().cast("array<struct<key:string,value:string>>")), F.array_compact(F.array(*named)))


def enrich(places: DataFrame, derive: dict[str, str] | None = None, cell: float = 0.25) -> DataFrame:
    """(id, tags): a place's own tags and those that each other polygon which the whole place is within gives.

    derive: tag of the holder (such as 'place=city') to the key that its name
    gives (such as 'addr:city'); without it the rules of derivations hold. Own tags win, then the smallest holder by its box, then key and
    value. One containment join by grid cells serves all keys; outlines are stored once, by their edges.
    """
    own = places.select("id", F.lit(0).alias("rank"), F.lit(0.0).alias("size"), F.explode("tags").alias("key", "value"))
    if derive is None:
        gives = derivations(F.col("tags"))
    else:
        name = t.name_or_ref(F.col("tags"))
        gives = F.array_compact(F.array(*[F.when((t.get(F.col("tags"), k.split("=")[0]) == k.split("=")[1]) & name.isNotNull(), F.struct(F.lit(v).alias("key"), name.alias("value"))) for k, v in derive.items()]))
    holders = places.where("kind = 'polygon'").withColumn("gives", gives).where("size(gives) > 0")
    held = containment.within(places.select("id", "kind", "rings"), holders.select(F.col("id").alias("area"), "rings"), cell).where("id <> area")
    given = with_box(holders).select(F.col("id").alias("area"), F.explode("gives").alias("g"), F.round((F.col("north") - F.col("south")) * (F.col("east") - F.col("west")), 9).alias("size"))
    rows = own.unionByName(held.join(given, "area").select("id", F.lit(1).alias("rank"), "size", F.col("g.key").alias("key"), F.col("g.value").alias("value")))
    return t.merge_maps(rows, ["id"], "key", "value", ["rank", "size"])
