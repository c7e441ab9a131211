"""Routes by waves of joins against plain best-first search over (node, last edge)."""

import heapq
import math
import random

import pytest

from terrane.plans import routing

EDGES, TURNS, NODES, QUERIES = "edge bigint, a bigint, b bigint, w double", "from_edge bigint, to_edge bigint, via_node bigint", "node bigint, lat double, lon double", "query bigint, source bigint, target bigint"


def metres(p, q):
    (a, b), (c, d) = p, q
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(h))


def plain(edges, turns, source, target):
    out = {}
    for e, a, b, w in edges:
        out.setdefault(a, []).append((e, b, w))
    heap, done = [(0.0, source, -1, ())], set()
    while heap:
        g, node, last, path = heapq.heappop(heap)
        if node == target:
            return g, list(path)
        if (node, last) in done:
            continue
        done.add((node, last))
        for e, b, w in out.get(node, ()):
            if (last, e, node) not in turns:
                heapq.heappush(heap, (g + w, b, e, (*path, e)))
    return None, []


def graph(seed, n=30):
    rnd = random.Random(seed)
    at = {i: (rnd.uniform(50, 50.5), rnd.uniform(30, 30.5)) for i in range(n)}
    edges = []
    for i in range(n):
        for j in rnd.sample(sorted(set(range(n)) - {i}, key=lambda j: metres(at[i], at[j]))[:9], 3):
            edges.append((len(edges), i, j, metres(at[i], at[j]) * rnd.uniform(1.0, 2.0)))
    into = {}
    for e, a, b, w in edges:
        into.setdefault(a, []).append(e)
    pairs = [(e, f, b) for e, a, b, w in edges for f in into.get(b, ())]
    return at, edges, set(rnd.sample(pairs, len(pairs) // 3))


@pytest.mark.parametrize("method", sorted(routing.METHODS))
def test_random_graph_with_turns(spark, method):
    at, edges, turns = graph(7)
    queries = [(q, q % 30, (q * 17 + 5) % 30) for q in range(12)] + [(90, 3, 3), (91, 3, 777), (92, 777, 3), (93, None, 3)]
    nodes = [(i, *p) for i, p in at.items() if i % 11]  # some nodes have no place, so no estimate
    got = routing.shortest_paths(spark.createDataFrame(queries, QUERIES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(nodes, NODES), spark.createDataFrame(sorted(turns), TURNS), method=method, factor=1.0)
    got = {r.query: (r.cost, r.path) for r in got.collect()}
    for q, a, b in queries:
        cost, path = plain(edges, turns, a, b) if a is not None else (None, [])
        assert got[q][1] == path and (cost is None and got[q][0] is None or got[q][0] == pytest.approx(cost)), q
    assert got[90] == (0.0, []) and got[91] == got[92] == got[93] == (None, [])


def test_barred_turn_hides_no_longer_way(spark):
    edges = spark.createDataFrame([(1, 0, 1, 1.0), (2, 1, 3, 1.0), (3, 0, 2, 1.0), (4, 2, 1, 1.5)], EDGES)
    turns, source = spark.createDataFrame([(1, 2, 1)], TURNS), spark.createDataFrame([(0,)], "source bigint")
    got = {r.node: r.cost for r in routing.k_hop_costs(edges, source, 3, restrictions=turns).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: 1.0, 3: 3.5}
    path = routing.shortest_paths(spark.createDataFrame([(1, 0, 3)], QUERIES), edges, spark.createDataFrame([], NODES), turns).first()
    assert (path.cost, path.path) == (3.5, [3, 4, 2])


def test_bounds_and_empty_tables(spark):
    edges = spark.createDataFrame([(1, 0, 1, 1.0), (2, 1, 2, 1.0), (3, 2, 3, 0.0)], EDGES)
    nodes, q = spark.createDataFrame([], NODES), spark.createDataFrame([(1, 0, 3), (2, 0, 1)], QUERIES)
    assert {r.query: r.cost for r in routing.shortest_paths(q, edges, nodes, most=1.5).collect()} == {1: None, 2: 1.0}
    assert {r.query: r.cost for r in routing.shortest_paths(q, edges, nodes, most=2.0).collect()} == {1: 2.0, 2: 1.0}
    assert {r.query: r.cost for r in routing.shortest_paths(q, edges, nodes, least=5.0).collect()} == {1: 15.0, 2: 5.0}
    assert routing.shortest_paths(q.limit(0), edges, nodes).collect() == []
    assert {r.cost for r in routing.shortest_paths(q, edges.limit(0), nodes).collect()} == {None}
