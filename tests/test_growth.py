"""Plans whose cost must not outgrow the input: results against brute force, and what the plan may not hold."""

import random

import pytest
from pyspark.sql import functions as F

from terrane import queries as engine
from terrane.functions import geo
from terrane.operators import crossings, rounds, snapping, spatial
from terrane.plans import documents, graph, routing

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_priority_reads_the_bag_once(spark):
    bags = spark.createDataFrame([(1, {"addr:city": "x", "addr:region": "y"}), (2, {"z": "1"}), (3, None), (4, {"addr:shop": None})], "id int, tags map<string,string>")
    got = bags.select("id", documents.priority(F.col("tags")).alias("p"), documents.priority(F.col("tags"), ["z", "addr:city", "z"]).alias("q"), documents.title(F.col("tags")).alias("t"))
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, 5, 2, "y, x"), (2, 0, 3, ""), (3, 0, 0, ""), (4, len(documents.LEVELS), 0, "")]
    assert "lambda" not in optimized(bags.select(documents.priority(F.col("tags"))))


def test_areas_over_the_date_line_meet_points_by_cells(spark):
    rnd = random.Random(3)
    points = [(i, rnd.uniform(-60, 60), rnd.uniform(-180, 180)) for i in range(400)] + [(400, None, 1.0), (401, 1.0, None)]
    areas = [(a, [[(y - 9.0, (x - 21 + 180) % 360 - 180), (y + 3.0, (x + 180) % 360 - 180), (y + 11.0, (x + 30 + 180) % 360 - 180)]]) for a, (y, x) in enumerate((rnd.uniform(-40, 40), rnd.uniform(-180, 180)) for _ in range(40))]
    p = spark.createDataFrame(points, "id int, lat double, lon double")
    a = spark.createDataFrame(areas, "area int, rings array<array<struct<lat:double,lon:double>>>")
    want = p.crossJoin(a).where(geo.in_rings_over_date_line(F.col("lat"), F.col("lon"), F.col("rings"))).select("id", "area")
    got = spatial.within_rings_over_date_line(p, a, "lat", "lon", 5.0).select("id", "area")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 20
    assert "NestedLoop" not in engine.QUERIES["date_line_areas"](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("short", [0, 3, 64])
def test_pairs_of_ways_come_out_once_without_a_distinct(spark, monkeypatch, short):
    monkeypatch.setattr(graph, "SHORT", short)
    rnd = random.Random(short)
    ways = [(i, [rnd.randrange(25) for _ in range(rnd.randrange(7))]) for i in range(40)] + [(40, [1, None, 1]), (41, None)]
    pairs = graph.shared_node_pairs(spark.createDataFrame(ways, "id bigint, nodes array<bigint>"))
    sets = {i: set(n or ()) - {None} for i, n in ways}
    assert sorted(map(tuple, pairs.collect())) == sorted((a, b) for a in sets for b in sets if a < b and sets[a] & sets[b])
    assert optimized(pairs).startswith("Union")


def test_sharp_turns_are_made_distinct_only_where_a_way_ends_twice(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 0.1, 1.0), (4, 0.05, 1.0), (5, 1.0, 0.0)], "id bigint, lat double, lon double")
    ways = [(10, [1, 2, 3, 1]), (11, [1, 4]), (12, [1, 3]), (13, [1, 5]), (14, [9, 1]), (15, [1])]
    bars = graph.sharp_restrictions(spark.createDataFrame(ways, "id bigint, nodes array<bigint>"), nodes).select("from_way", "to_way", "via_node")
    near = (10, 11, 12)
    assert sorted(map(tuple, bars.collect())) == sorted((a, b, 1) for a in near for b in near if a != b)
    assert optimized(bars).startswith("Union")


def test_crossings_are_dealt_by_their_pairs_and_not_by_their_bytes(spark):
    rnd = random.Random(7)
    shapes = lambda n: [(i, [{"lat": float(rnd.randrange(12)), "lon": float(rnd.randrange(12))} for _ in range(rnd.randrange(1, 5))], i % 3 == 0) for i in range(n)]
    a, b = shapes(60), shapes(50)
    frame = lambda rows: spark.createDataFrame(rows, "id int, shape array<struct<lat:double,lon:double>>, closed boolean")
    got = crossings.crossings(frame(a), frame(b), 2.5)

    def pieces(shape, closed):
        p = [(x["lat"], x["lon"]) for x in shape]
        return list(enumerate(zip(p, p[1:] + p[:1]) if closed else zip(p, p[1:])))

    want = set()
    for i, s, c in a:
        for j, t, d in b:
            for k, ((y1, x1), (y2, x2)) in pieces(s, c):
                for m, ((y3, x3), (y4, x4)) in pieces(t, d):
                    whole = (x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3)
                    if whole and 0 <= ((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / whole <= 1 and 0 <= ((x3 - x1) * (y2 - y1) - (y3 - y1) * (x2 - x1)) / whole <= 1:
                        want.add((i, j, k, m))
    rows = [tuple(r)[:4] for r in got.collect()]
    assert sorted(rows) == sorted(want) and len(want) > 500
    plan = crossings.crossings(frame(a), frame(b), 2.5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 4
    joins = [line for line in plan.splitlines() if "Join" in line and "cy#" in line]
    assert joins and not any(" / " in line for line in joins)  # places are divided out behind the join


def test_search_edges_read_the_callers_ways_once_and_gather_no_shapes_unasked(spark):
    df = engine.QUERIES["search_edges"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "lineitem.parquet" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_a_wave_of_few_labels_shuffles_no_graph(spark, monkeypatch, few):
    monkeypatch.setattr(routing, "FEW", few)
    written, keep = {}, rounds.Rounds.keep
    monkeypatch.setattr(rounds.Rounds, "keep", lambda self, df, name: (written.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString()), keep(self, df, name))[1])
    rnd = random.Random(5)
    edges = [(i, rnd.randrange(12), rnd.randrange(12), rnd.random()) for i in range(40)]
    bars = [(a[0], b[0], b[1]) for a in edges for b in edges if a[2] == b[1] and (a[0] + b[0]) % 4 == 0]
    e, t = spark.createDataFrame(edges, "edge bigint, a bigint, b bigint, w double"), spark.createDataFrame(bars, "from_edge bigint, to_edge bigint, via_node bigint")
    q = spark.createDataFrame([(1, 0, 5)], "query bigint, source bigint, target bigint")
    n = spark.createDataFrame([(i, 0.0, 0.0) for i in range(12)], "node bigint, lat double, lon double")
    [found] = routing.shortest_paths(q, e, n, t).collect()
    best = {x[0]: x[3] for x in edges if x[1] == 0}
    for _ in edges:
        for a in edges:
            for b in edges:
                if a[0] in best and a[2] == b[1] and (a[0] + b[0]) % 4:
                    best[b[0]] = min(best.get(b[0], 9e9), best[a[0]] + b[3])
    assert abs(found.cost - min(c for k, c in best.items() if edges[k][2] == 5)) < 1e-9
    assert ("strategy=broadcast" in written["labels"][-1]) == bool(few)


def test_nearest_lines_neither_sort_nor_gather_pairs(spark, monkeypatch):
    written, keep = {}, rounds.Rounds.keep
    monkeypatch.setattr(rounds.Rounds, "keep", lambda self, df, name: (written.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString()), keep(self, df, name))[1])
    rnd = random.Random(9)
    points = [(i, float(rnd.randrange(20)), float(rnd.randrange(20))) for i in range(50)]
    lines = [(j, [{"lat": float(rnd.randrange(20)), "lon": float(rnd.randrange(20))} for _ in range(2)]) for j in range(30)] + [(30 + j, [{"lat": 4.0, "lon": 4.0}, {"lat": 9.0, "lon": 9.0}]) for j in range(3)]
    got = snapping.nearest_lines(spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(lines, "line int, shape array<struct<lat:double,lon:double>>"), 1.0)

    def away(y, x, s):
        (a, b), (c, d) = ((p["lat"], p["lon"]) for p in s)
        size = (c - a) ** 2 + (d - b) ** 2
        t = max(0.0, min(1.0, ((x - b) * (d - b) + (y - a) * (c - a)) / size)) if size else 0.0
        return round(((a + t * (c - a) - y) ** 2 + (b + t * (d - b) - x) ** 2) ** 0.5, 9)

    want = {i: min((away(y, x, s), j) for j, s in lines) for i, y, x in points}
    assert {r.id: (r.distance, r.line) for r in got.collect()} == want
    assert all("HashAggregate" in p and "SortAggregate" not in p for p in written["least"])
