"""Stitched routes, crossings and places along lines."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from terrane.functions import geo
from terrane.operators.crossings import crossings
from terrane.plans import stitch, vehicle

EDGE = "route int, k int, from_node int, to_node int, shape array<struct<lat:double,lon:double>>, attributes map<string,string>"
END = "route int, s_lat double, s_lon double, s_offset int, t_lat double, t_lon double, t_offset int"
LINE = lambda *xs: [(0.0, float(x)) for x in xs]


def one(spark, edges, end):
    r = stitch.stitch(spark.createDataFrame([(1, *e) for e in edges], EDGE), spark.createDataFrame([(1, *end)], END)).first()
    return [p.lon for p in r.shape], [(m.shape, m.attributes) for m in r.meta], [(s.shape, s.lon) for s in r.stops]


def test_orientation_trimming_and_runs(spark):
    a, b = {"name": "A"}, {"name": "B"}
    edges = [(0, 10, 11, LINE(0, 1, 2), a), (1, 12, 11, LINE(5, 4, 3, 2), a), (2, 12, 13, LINE(5), b), (3, 12, 13, LINE(5, 6, 7), b), (4, 14, 13, LINE(9, 8, 7), None)]
    shape, meta, stops = one(spark, edges, (0.0, 0.5, 1, 0.0, 8.5, 1))
    assert shape == [0.5, 1, 2, 3, 4, 5, 6, 7, 8, 8.5]
    assert meta == [(0, a), (6, b), (8, {})] and stops == [(0, 0.5), (9, 8.5)]


def test_edges_that_share_no_node_go_from_the_nearer_end(spark):
    edges = [(0, 1, 2, LINE(0, 1, 2), None), (1, 3, 4, LINE(4, 3, 2.5), None), (2, 5, 6, LINE(7, 6, 4.5), None)]
    shape, _, _ = one(spark, edges, (0.0, 0.4, 1, 0.0, 6.5, 1))
    assert shape == [0.4, 1, 2, 2.5, 3, 4, 4.5, 6, 6.5]


def test_one_edge_both_ways(spark):
    edge = [(0, 1, 2, LINE(0, 1, 2, 3), {"n": "x"})]
    assert one(spark, edge, (0.0, 0.5, 1, 0.0, 2.5, 3))[0] == [0.5, 1, 2, 2.5]
    assert one(spark, edge, (0.0, 2.5, 3, 0.0, 0.5, 1))[0] == [2.5, 2, 1, 0.5]
    assert one(spark, edge, (0.0, 1.2, 2, 0.0, 1.8, 2))[0] == [1.2, 1.8]
    empty = stitch.stitch(spark.createDataFrame([], EDGE), spark.createDataFrame([], END))
    assert empty.count() == 0 == stitch.route_json(empty).count() == stitch.route_geojson(empty).count()


def test_json_forms_parse(spark):
    edges = [(1, 0, 1, 2, LINE(0, 1), {"name": 'say "hi"'}), (1, 1, 2, 3, LINE(1, 2), {"name": "b"})]
    r = stitch.stitch(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(1, 0.0, 0.1, 1, 0.0, 1.5, 1)], END))
    doc = json.loads(stitch.route_json(r).first().json)
    assert doc["Shape"] == [[0.1, 0.0], [1.0, 0.0], [1.5, 0.0]] and doc["ShapeMeta"][0] == {"Shape": 0, "Attributes": {"name": 'say "hi"'}} and doc["Stops"][1] == {"Shape": 2, "Coordinates": [1.5, 0.0]}
    features = json.loads(stitch.route_geojson(r).first().geojson)["features"]
    assert [f["geometry"]["type"] for f in features] == ["LineString", "Point", "Point"] and features[0]["geometry"]["coordinates"] == doc["Shape"]


def test_crossings_of_outlines_and_lines(spark):
    rnd = random.Random(2)
    shape = lambda n: [(rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for _ in range(n)]
    a, b = [(i, shape(4), i % 2 == 0) for i in range(12)] + [(50, [(1.0, 1.0)], False)], [(i, shape(3), True) for i in range(12)]
    steps = lambda s, closed: list(zip(s, s[1:] + s[:1])) if closed else list(zip(s, s[1:]))

    def cross(p, q, r, s):
        size = (q[1] - p[1]) * (s[0] - r[0]) - (q[0] - p[0]) * (s[1] - r[1])
        t, u = ((r[1] - p[1]) * (s[0] - r[0]) - (r[0] - p[0]) * (s[1] - r[1])) / size, ((r[1] - p[1]) * (q[0] - p[0]) - (r[0] - p[0]) * (q[1] - p[1])) / size
        return (p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])) if 0 <= t <= 1 and 0 <= u <= 1 else None

    want = {(i, j, m, n): c for i, s, x in a for j, t, y in b for m, e in enumerate(steps(s, x)) for n, f in enumerate(steps(t, y)) if (c := cross(*e, *f))}
    schema = "id int, shape array<struct<lat:double,lon:double>>, closed boolean"
    for size in (1.5, 40.0):
        got = {(r.a, r.b, r.a_seg, r.b_seg): (r.lat, r.lon) for r in crossings(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), size).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_places_along_lines_and_offsets(spark):
    metre = math.degrees(1 / geo.EARTH)
    df = spark.createDataFrame([(LINE(0, 1, 1, 3),), (LINE(7),), ([],)], "p array<struct<lat:double,lon:double>>")
    at = lambda d: [r.x and round(r.x.lon, 6) for r in df.select(geo.along_line(F.col("p"), F.lit(float(d))).alias("x")).collect()]
    one = 1 / metre
    assert at(0) == [0.0, 7.0, None] and at(one / 2)[0] == 0.5 and at(one)[0] == 1.0 and at(2 * one)[0] == 2.0 and at(9 * one)[0] == 3.0 and at(-5)[0] == 0.0
    lat, lon = geo.offset_both(F.lit(0.0), F.lit(10.0), F.lit(one), F.lit(2 * one))
    r = df.select(lat.alias("y"), lon.alias("x")).first()
    assert (round(r.y, 9), round(r.x, 9)) == (1.0, 12.0)


def test_script_car_drives_three_quarters(spark):
    df = spark.createDataFrame([({"highway": "primary"},), ({"highway": "primary", "maxspeed": "50 mph"},)], "tags map<string,string>")
    got = [r.s for r in df.select(vehicle.speed(F.col("tags"), vehicle.PROFILES["car_script"]).alias("s")).collect()]
    assert got == [67.5, pytest.approx(50 * 1.60934 * 0.75)] and vehicle.metre_bounds(vehicle.PROFILES["car_script"]) == (3.6 / 200, 3.6 / 30)
