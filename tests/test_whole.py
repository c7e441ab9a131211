"""Queries over whole tables against brute force: no order, line or point is left out."""

import tempfile
from collections import defaultdict

import pytest

from terrane import queries as engine

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").collect()


def got(spark, name, *columns):
    return {tuple(r) for r in engine.QUERIES[name](spark, SF).select(*columns).collect()}


def test_shared_node_pairs(spark, lines):
    by = defaultdict(set)
    for r in lines:
        by[r.l_partkey].add(r.l_orderkey)
    assert got(spark, "shared_node_pairs_whole", "a", "b") == {(a, b) for s in by.values() for a in s for b in s if a < b}


def test_restriction_lift(spark, lines):
    by, want = defaultdict(list), set()
    for r in lines:
        by[r.l_orderkey].append((r.l_orderkey * 10 + r.l_linenumber, r.l_partkey, r.l_suppkey))
    for edges in by.values():
        for via in {e[1] for e in edges}:
            at = [e[0] for e in edges if via in e[1:]]
            want |= {(f, t, via) for f in at for t in at}
    assert got(spark, "restriction_lift_whole", "from_edge", "to_edge", "via_node") == want


def test_rings_hold_every_point(spark):
    # a table of 300 customers of one nation is more than any cap that the queries had
    c = spark.read.parquet(f"{SF}/customer.parquet").limit(1).drop("c_custkey", "c_nationkey").crossJoin(spark.range(1, 301).selectExpr("id * 7919 as c_custkey", "cast(7 as bigint) as c_nationkey"))
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    c.write.parquet(f"{folder}/customer.parquet")
    assert engine.QUERIES["simplified_lines"](spark, folder).first().n_before == 300
    assert engine.QUERIES["svg_path_whole"](spark, folder).first().path.count(" L") == 299
    points = [((k * 37) % 17000 / 100 - 85, (k * 91) % 36000 / 100 - 180) for k in range(7919, 301 * 7919, 7919)]
    twice = sum(x * b - y * a for (a, x), (b, y) in zip(points, points[1:] + points[:1]))
    assert abs(twice) > 100 and abs(abs(engine.QUERIES["polygon_area_whole"](spark, folder).first().area) - abs(twice) / 2) < 0.001
    c = engine.QUERIES["centroid_whole"](spark, folder).first()
    cross = [x * b - y * a for (a, x), (b, y) in zip(points, points[1:] + points[:1])]
    for got_at, k in ((c.lat, 0), (c.lon, 1)):
        assert abs(got_at - sum((p[k] + q[k]) * w for p, q, w in zip(points, points[1:] + points[:1], cross)) / (3 * twice)) < 0.001
