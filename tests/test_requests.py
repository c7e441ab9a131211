import json

import pytest
from pyspark.sql import functions as F

from terrane.functions import requests
from terrane.plans import graph, render, routing


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_map_ids(spark):
    got = one(spark, requests.map_ids(F.lit("R123, w5,r123,,N7")))[0]
    assert [tuple(x) for x in got] == [("relation", 123), ("way", 5), ("node", 7)]
    assert one(spark, requests.map_id(F.lit(None).cast("string")), requests.map_ids(F.lit(""))) == (None, [])
    for bad in ("X1", "R", "Rx", ""):
        with pytest.raises(Exception, match="not a map id"):
            one(spark, requests.map_id(F.lit(bad)))


def test_parse_box(spark):
    assert tuple(one(spark, requests.parse_box(F.lit("5, 6,1,2")))[0]) == (1.0, 2.0, 5.0, 6.0)
    assert one(spark, requests.parse_box(F.lit("1,2,3")), requests.parse_box(F.lit("1,2,x,4")), requests.parse_box(F.lit(None).cast("string"))) == (None, None, None)


def test_attribute_objects():
    assert requests.attribute_objects('[{"a":"1"},{"b":"2"}]') == [{"a": "1"}, {"b": "2"}]
    assert requests.attribute_objects('{"a":"1"},{"b":"2"}') == [{"a": "1"}, {"b": "2"}]
    assert [requests.attribute_objects(t) for t in (None, " ", "{a", "5", '"x"', '{"a":{"b":"c"}}')] == [[]] * 6


def test_needs_search(spark):
    rows = [(1, 5, 2, 5, 0, True), (1, 9, 1, 5, 1, True), (1, 5, 1, 9, 4, False), (1, 5, 1, 9, 2, True), (1, 9, 1, 5, 5, False), (1, 9, 1, 5, 0, False), (1, 9, 1, 5, None, False)]
    df = spark.createDataFrame(rows, "a int, x int, b int, y int, d int, want boolean")
    assert df.where(routing.needs_search(F.col("a"), F.col("x"), F.col("b"), F.col("y"), F.col("d")) != F.col("want")).count() == 0


def test_least_cost_of_an_edge(spark):
    edges = spark.createDataFrame([(1, 1, 2, 0.0), (2, 2, 3, 0.0), (3, 1, 3, 5.0)], "edge long, a long, b long, w double")
    nodes = spark.createDataFrame([(n, 0.0, float(n)) for n in (1, 2, 3)], "node long, lat double, lon double")
    q = spark.createDataFrame([(1, 1, 3)], "query long, source long, target long")
    assert routing.shortest_paths(q, edges, nodes, least=3.0).first().cost == 5.0
    assert routing.shortest_paths(q, edges, nodes).first().cost == 0.0


def test_route_geojson(spark):
    p = [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)]
    edges = spark.createDataFrame([(1, 1, True, p[:2], {"name": "a"}), (1, 2, False, [p[2], p[1]], None), (1, 3, True, p[2:], None)], "route int, k int, forward boolean, shape array<struct<lat:double,lon:double>>, attributes map<string,string>")
    stops = spark.createDataFrame([(1, 1, 2, 5.0, 6.0, {"s": "t"})], "route int, k int, shape_index int, lat double, lon double, attributes map<string,string>")
    features = json.loads(render.route_geojson(edges, stops).first().geojson)["features"]
    assert [f["geometry"]["coordinates"] for f in features] == [[[2.0, 1.0], [4.0, 3.0]], [[4.0, 3.0], [6.0, 5.0]], [6.0, 5.0]]
    assert [f["properties"] for f in features] == [{"name": "a"}, {}, {"s": "t"}] and features[2]["Shape"] == "2"
    assert len(json.loads(render.route_geojson(edges).first().geojson)["features"]) == 2


def test_each_restriction_tag_is_a_row(spark):
    members = "array<struct<type:int,id:long,role:string>>"
    rel = spark.createDataFrame([(1, {"restriction": "no_left_turn", "restriction:hgv": "no_u_turn", "restriction:bus": "yes"}, [(1, 10, "from"), (1, 11, "to"), (0, 2, "via")])], f"id long, tags map<string,string>, members {members}")
    assert sorted(tuple(r) for r in graph.relation_restrictions(rel).collect()) == [("hgv", "no_u_turn", 10, 11, 2), ("motorcar", "no_left_turn", 10, 11, 2)]
