"""Routes from their edges: shapes in one direction, trimmed at both ends, with runs of equal attributes and stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo


def _point(lat: str, lon: str) -> Column:
    return F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"))


def _metres(a: Column, b: Column) -> Column:
    return geo.haversine(a["lat"], a["lon"], b["lat"], b["lon"])


def _first(shape: Column) -> Column:
    return F.get(shape, F.lit(0))


def _last(shape: Column) -> Column:
    return F.get(shape, F.size(shape) - 1)


def _skip(points: Column, n) -> Column:
    return F.slice(points, n + 1, F.greatest(F.size(points) - n, F.lit(0)))


def _take(points: Column, n) -> Column:
    return F.slice(points, 1, F.greatest(n, F.lit(0)))


def stitch(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(route, shape, meta, stops): one row a route.

    edges: route, k, from_node, to_node, shape, attributes, in order of k, the first and last being those of both
    ends. ends: route, s_lat, s_lon, s_offset, t_lat, t_lon, t_offset; an offset is the number of the first
    point of an edge's shape after the place. An edge runs forward if the one before (for
    the first: after) touches its from (to) node, backward if it touches the other one, else from
    the end that is nearer. A common point of two edges stands once. Edges of fewer than two
    points between the ends are left out. meta: for each run of edges with equal attributes, where it begins in the
    shape, and the attributes. Routes without ends have no row. A route's pieces meet in one row, which its length bounds.
    """
    w = Window.partitionBy("route").orderBy("k")
    e = edges.select("route", "k", "from_node", "to_node", "shape", "attributes", F.array_sort(F.map_entries(F.coalesce("attributes", F.create_map().cast("map<string,string>")))).alias("pairs"))
    near = lambda f, c: f(F.col(c)).over(w)
    e = e.withColumns({
        "p_from": near(F.lag, "from_node"), "p_to": near(F.lag, "to_node"), "p_shape": F.lag(F.array(_first(F.col("shape")), _last(F.col("shape")))).over(w), "n_from": near(F.lead, "from_node"), "n_to": near(F.lead, "to_node"),
        "at": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy("route")),
    }).join(ends, "route")
    source, target = _point("s_lat", "s_lon"), _point("t_lat", "t_lon")
    shape, head, tail = F.col("shape"), _first(F.col("shape")), _last(F.col("shape"))
    touches = lambda node, a, b: F.coalesce((F.col(node) == F.col(a)) | (F.col(node) == F.col(b)), F.lit(False))
    from_before, to_before = touches("from_node", "p_from", "p_to"), touches("to_node", "p_from", "p_to")
    to_next, from_next = touches("to_node", "n_from", "n_to"), touches("from_node", "n_from", "n_to")
    far = lambda p: F.least(_metres(F.get("p_shape", F.lit(0)), p), _metres(F.get("p_shape", F.lit(1)), p))
    first, last, alone = F.col("at") == 1, F.col("at") == F.col("n"), F.col("n") == 1
    forward = (
        F.when(alone, F.col("s_offset") <= F.col("t_offset"))
        .when(first, F.when(to_next, True).when(from_next, False).otherwise(_metres(source, head) <= _metres(source, tail)))
        .otherwise(F.when(from_before, True).when(to_before, False).otherwise(far(head) <= far(tail)))
    )
    e = e.withColumns({"forward": forward, "common": (~first & (from_before | to_before)).cast("int")})
    e = e.withColumns({"way": F.when(F.col("forward"), shape).otherwise(F.reverse(shape))})
    so, to = (F.when(F.col("forward"), F.col(c)).otherwise(F.size("shape") - F.col(c)) for c in ("s_offset", "t_offset"))
    way = F.col("way")
    points = (
        F.when(alone, F.concat(F.array(source), _skip(_take(way, to), so), F.array(target)))
        .when(first, F.concat(F.array(source), _skip(way, so)))
        .when(last, F.concat(_skip(_take(way, to), F.col("common")), F.array(target)))
        .otherwise(_skip(way, F.col("common")))
    )
    e = e.where(first | last | (F.size("shape") > 1))
    pieces = e.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("k", points.alias("points"), "pairs"))).alias("p"), F.first(source).alias("source"), F.first(target).alias("target"))
    begun = F.array().cast("array<struct<shape:int,pairs:array<struct<key:string,value:string>>>>")

    def run(acc, piece):
        same = F.coalesce(F.element_at(acc["meta"], -1)["pairs"] == piece["pairs"], F.lit(False))
        more = F.array(F.struct(acc["at"].alias("shape"), piece["pairs"].alias("pairs")))
        return F.struct(F.when(same, acc["meta"]).otherwise(F.concat(acc["meta"], more)).alias("meta"), (acc["at"] + F.size(piece["points"])).alias("at"))

    start = F.struct(begun.alias("meta"), F.lit(0).alias("at"))
    meta = F.aggregate("p", start, lambda acc, x: F.when(F.size(acc["meta"]) == 0, F.struct(F.array(F.struct(F.lit(0).alias("shape"), x["pairs"].alias("pairs"))).alias("meta"), F.size(x["points"]).alias("at"))).otherwise(run(acc, x)))["meta"]
    out = pieces.select("route", F.flatten(F.transform("p", lambda x: x["points"])).alias("shape"), F.transform(meta, lambda m: F.struct(m["shape"].alias("shape"), F.map_from_entries(m["pairs"]).alias("attributes"))).alias("meta"), "source", "target")
    stop = lambda at, p: F.struct(at.alias("shape"), F.col(p)["lat"].alias("lat"), F.col(p)["lon"].alias("lon"))
    return out.select("route", "shape", "meta", F.array(stop(F.lit(0), "source"), stop(F.size("shape") - 1, "target")).alias("stops"))


def _pair(p) -> Column:
    return F.concat(F.lit("["), p["lon"].cast("string"), F.lit(","), p["lat"].cast("string"), F.lit("]"))


def route_json(routes: DataFrame) -> DataFrame:
    """(route, json) of stitched routes: Shape, ShapeMeta with Attributes, Stops with Coordinates; points are [lon,lat]."""
    listed = lambda c, f: F.concat(F.lit("["), F.array_join(F.transform(c, f), ","), F.lit("]"))
    meta = lambda m: F.concat(F.lit('{"Shape":'), m["shape"].cast("string"), F.lit(',"Attributes":'), F.to_json(m["attributes"]), F.lit("}"))
    stop = lambda s: F.concat(F.lit('{"Shape":'), s["shape"].cast("string"), F.lit(',"Coordinates":'), _pair(s), F.lit("}"))
    return routes.select("route", F.concat(F.lit('{"Shape":'), listed("shape", _pair), F.lit(',"ShapeMeta":'), listed("meta", meta), F.lit(',"Stops":'), listed("stops", stop), F.lit("}")).alias("json"))


def route_geojson(routes: DataFrame) -> DataFrame:
    """(route, geojson) of stitched routes: a line for each run of equal attributes, up to where the next one begins, then a point for each stop. Runs of one point have no line."""
    until = lambda i: F.coalesce(F.get("meta", i + 1)["shape"], F.size("shape") - 1)
    cut = lambda m, i: F.slice("shape", m["shape"] + 1, until(i) - m["shape"] + 1)
    lines = F.transform("meta", lambda m, i: F.struct(cut(m, i).alias("points"), m["attributes"].alias("attributes")))
    line = lambda x: F.concat(F.lit('{"type":"Feature","name":"ShapeMeta","geometry":{"type":"LineString","coordinates":['), F.array_join(F.transform(x["points"], _pair), ","), F.lit(']},"properties":'), F.to_json(x["attributes"]), F.lit("}"))
    stop = lambda s: F.concat(F.lit('{"type":"Feature","name":"Stop","Shape":"'), s["shape"].cast("string"), F.lit('","geometry":{"type":"Point","coordinates":'), _pair(s), F.lit('},"properties":{}}'))
    features = F.concat(F.transform(F.filter(lines, lambda x: F.size(x["points"]) > 1), line), F.transform("stops", stop))
    return routes.select("route", F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(features, ","), F.lit("]}")).alias("geojson"))
