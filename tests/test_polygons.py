"""Union and difference of polygons against point tests and areas; relations folded in the order of their members."""

import math
import random

import pytest

from terrane.functions.polygons import DIFFERENCE, UNION, combine, fold
from terrane.plans import places

from .test_spatial_joins import in_rings


def area(rings):
    """By even-odd depth: a ring inside an odd number of others is a hole."""
    total = 0.0
    for k, r in enumerate(rings):
        p = ((r[0][0] + r[1][0]) / 2, (r[0][1] + r[1][1]) / 2)
        depth = sum(in_rings(p, [s]) for j, s in enumerate(rings) if j != k)
        total += (-1) ** depth * abs(sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(r, r[1:]))) / 2
    return total


def box(s, w, n, e):
    return [(s, w), (s, e), (n, e), (n, w), (s, w)]


@pytest.mark.parametrize("seed", range(12))
def test_random_polygons(seed):
    rnd = random.Random(seed)
    star = lambda: [(y0 + r * math.sin(a), x0 + r * math.cos(a)) for y0, x0 in [(rnd.uniform(-2, 2), rnd.uniform(-2, 2))] for a, r in ((2 * math.pi * k / 9, rnd.uniform(1, 5)) for k in range(9))]
    if seed % 3 == 0:  # shapes on a lattice touch and overlap
        star = lambda: [(float(rnd.randint(-3, 3)), float(rnd.randint(-3, 3))) for _ in range(6)]
    a, b = [star()], [star(), star()]
    for keep in (UNION, DIFFERENCE):
        got = combine(a, b, keep)
        for _ in range(400):
            p = (rnd.uniform(-7, 7) + 1e-4, rnd.uniform(-7, 7) + 1e-4)
            assert in_rings(p, got) == bool(keep(in_rings(p, a), in_rings(p, b))), p


def test_touching_overlapping_and_nested():
    assert area(combine([box(0, 0, 2, 2)], [box(0, 2, 2, 4)])) == 8.0 and len(combine([box(0, 0, 2, 2)], [box(0, 2, 2, 4)])) == 1
    assert area(combine([box(0, 0, 2, 2)], [box(1, 1, 3, 3)])) == 7.0 and area(combine([box(0, 0, 2, 2)], [box(0, 0, 2, 2)])) == 4.0
    ring = combine([box(0, 0, 9, 9)], [box(3, 3, 6, 6)], DIFFERENCE)
    assert area(ring) == 72.0 and len(ring) == 2 and area(combine(ring, [box(4, 4, 5, 5)])) == 73.0
    assert combine([box(0, 0, 1, 1)], [box(-1, -1, 2, 2)], DIFFERENCE) == [] == combine([], []) and area(combine([], [box(0, 0, 1, 1)])) == 1.0
    assert sorted(combine([box(0, 0, 2, 2)], [])[0][:4]) == [(0, 0), (0, 2), (2, 0), (2, 2)]
    assert area(fold([("outer", [box(0, 0, 4, 4), box(2, 2, 6, 6)]), ("inner", [box(1, 1, 3, 3)]), ("outer", [box(1, 1, 2, 2)])])) == 16 + 16 - 4 - 4 + 1


def test_relation_polygons_fold_their_runs_in_order(spark):
    ways, nodes, members = [], [], []
    for k, (role, ring) in enumerate([("outer", box(0, 0, 4, 4)), ("outer", box(2, 2, 6, 6)), ("inner", box(1, 1, 3, 3)), ("outer", box(1, 1, 2, 2))]):
        ids = [10 * k + i for i in (1, 2, 3, 4)]
        nodes += [(n, float(y), float(x)) for n, (y, x) in zip(ids, ring)]
        halves = [(100 + 2 * k, ids[:3]), (101 + 2 * k, [ids[2], ids[3], ids[0]])]
        ways += halves
        members += [(w, role, 1) for w, _ in halves]
    rel = spark.createDataFrame([(5, {"place": "city"}, members + [(1, "admin_centre", 0)]), (6, {"place": "x"}, [(999, "outer", 1)])], "id bigint, tags map<string,string>, members array<struct<id:bigint,role:string,type:int>>")
    got = places.relation_places(rel, spark.createDataFrame(ways, "id bigint, nodes array<bigint>"), spark.createDataFrame(nodes, "id bigint, lat double, lon double"), ["place"]).collect()
    assert [r.id for r in got] == [5] and area([[(p.lat, p.lon) for p in r] for r in got[0].rings]) == 16 + 16 - 4 - 4 + 1
