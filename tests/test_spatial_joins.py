"""Grid joins against comparing all with all: nearest lines, points and shapes in areas, enrichment."""

import math
import random

import pytest

from terrane.operators.containment import AreaCells, within
from terrane.operators.snapping import nearest_lines, snap
from terrane.plans import places

SHAPE = "array<struct<lat:double,lon:double>>"


def closest(p, a, b):
    dy, dx = b[0] - a[0], b[1] - a[1]
    size = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[1] - a[1]) * dx + (p[0] - a[0]) * dy) / size)) if size else 0.0
    return math.hypot(a[0] + t * dy - p[0], a[1] + t * dx - p[1])


def in_rings(p, rings):
    odd = False
    for ring in rings:
        for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > p[0]) != (y2 > p[0]) and p[1] < (p[0] - y1) * (x2 - x1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def apart(a, b, c, d):
    side = lambda p, q, r: (q[1] - p[1]) * (r[0] - p[0]) - (q[0] - p[0]) * (r[1] - p[1])
    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


@pytest.mark.parametrize("k, size", [(1, 0.5), (3, 2.0)])
def test_nearest_lines(spark, k, size):
    rnd = random.Random(k)
    near = lambda y, x, s: (y + rnd.uniform(-s, s), x + rnd.uniform(-s, s))
    lines = [(i, [near(10, 10, 4) for _ in range(rnd.choice([2, 3, 5]))]) for i in range(40)] + [(50, [(70.0, 100.0), (-60.0, 120.0)]), (51, [(0.0, 0.0)]), (52, [(9.0, 9.0), (9.0, 9.0)])]
    points = [(i, *near(10, 10, 6)) for i in range(60)] + [(100, -80.0, -170.0), (101, 60.0, 101.5), (102, None, 3.0)]
    got = {}
    for r in nearest_lines(spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(lines, f"line int, shape {SHAPE}"), size, k).collect():
        got.setdefault(r.id, []).append((r.distance, r.line))
    for i, y, x in points[:-1]:
        every = sorted((round(min(closest((y, x), a, b) for a, b in zip(s, s[1:])), 9), n) for n, s in lines if len(s) > 1)
        assert [n for _, n in sorted(got[i])] == [n for _, n in every[:k]], i
        assert [d for d, _ in sorted(got[i])] == pytest.approx([d for d, _ in every[:k]], abs=1e-8)
    assert 102 not in got


def test_snap_reads_directions_and_offsets(spark):
    edges = [(1, [(0.0, 0.0), (0.0, 1.0), (0.0, 2.0)], 0, 1.0), (2, [(0.001, 0.0), (0.001, 2.0)], 4, 1.0), (3, [(0.001, 0.0), (0.001, 2.0)], 1, None), (4, [(5.0, 0.0), (5.0, 2.0)], 2, 1.0)]
    e = spark.createDataFrame(edges, f"edge int, shape {SHAPE}, direction int, weight double")
    got = {r.id: (r.edge, r.offset) for r in snap(spark.createDataFrame([(1, 0.001, 1.5), (2, 0.0, 0.25), (3, 4.0, 1.0), (4, 0.0, 1.0)], "id int, lat double, lon double"), e, 0.1).collect()}
    assert got == {1: (1, 2), 2: (1, 1), 3: (4, 1), 4: (1, 1)}
    assert snap(spark.createDataFrame([(1, 0.0, 1.0)], "id int, lat double, lon double"), e.limit(0), 0.1).count() == 0


def areas_of(rnd, n=9):
    out = []
    for i in range(n):
        y, x, r = rnd.uniform(-20, 20), rnd.uniform(-20, 20), rnd.uniform(2, 12)
        star = [(y + r * f * math.sin(a), x + r * f * math.cos(a)) for a, f in ((2 * math.pi * j / 11, rnd.uniform(0.4, 1.0)) for j in range(11))]
        hole = [(y + 0.3 * r * math.sin(a), x + 0.3 * r * math.cos(a)) for a in (0.3, 1.9, 3.6, 5.0)]
        out.append((i, [star, hole] if i % 2 else [star]))
    return out + [(90, [[(0.0, 0.0), (0.0, 30.0), (8.0, 30.0), (8.0, 8.0), (30.0, 8.0), (30.0, 0.0)]]), (91, []), (92, [[(1.0, 1.0)]])]


@pytest.mark.parametrize("size", [0.7, 3.0, 25.0])
def test_points_in_areas(spark, size):
    rnd = random.Random(3)
    areas = areas_of(rnd)
    points = [(i, rnd.uniform(-30, 32), rnd.uniform(-30, 32)) for i in range(500)]
    grid = AreaCells(spark.createDataFrame(areas, f"area int, rings array<{SHAPE}>"), size)
    got = {(r.id, r.area) for r in grid.holding(spark.createDataFrame(points, "id int, lat double, lon double")).collect()}
    assert got == {(i, a) for i, y, x in points for a, rings in areas if in_rings((y, x), rings)} and got


def test_shapes_in_areas(spark):
    rnd = random.Random(8)
    areas, shapes = areas_of(rnd), []
    for i in range(300):
        y, x, s = rnd.uniform(-25, 30), rnd.uniform(-25, 30), rnd.choice([0.5, 3.0, 9.0])
        pts = [(y + rnd.uniform(-s, s), x + rnd.uniform(-s, s)) for _ in range(4)]
        shapes.append((i, *rnd.choice([("point", [pts[:1]]), ("line", [pts[:3]]), ("polygon", [pts[:3]])])))
    ring = areas[1][1][1]  # a polygon round a hole
    mid = [sum(p[k] for p in ring) / 4 for k in (0, 1)]
    shapes.append((900, "polygon", [[(mid[0] + (p[0] - mid[0]) * 1.05, mid[1] + (p[1] - mid[1]) * 1.05) for p in ring]]))
    shapes.append((901, "line", [[(25.0, 3.0), (3.0, 25.0)]]))  # over the notch of the L
    got = {(r.id, r.area) for r in within(spark.createDataFrame(shapes, f"id int, kind string, rings array<{SHAPE}>"), spark.createDataFrame(areas, f"area int, rings array<{SHAPE}>"), 2.0).collect()}
    want, crossed, holed = set(), 0, 0
    for i, kind, (pts,) in shapes:
        steps = list(zip(pts, pts[1:] + pts[:1])) if kind == "polygon" else list(zip(pts, pts[1:]))
        for a, rings in areas:
            if all(in_rings(p, rings) for p in pts):
                cross = any(apart(*s, c, d) for s in steps for r in rings for c, d in zip(r, r[1:] + r[:1]))
                hole = kind == "polygon" and any(in_rings(r[0], [pts]) for r in rings if r)
                crossed, holed = crossed + cross, holed + (hole and not cross)
                if not cross and not hole:
                    want.add((i, a))
    assert got == want and want and crossed and holed


def test_an_l_shape_is_enriched_by_the_area_that_holds_it(spark):
    area = lambda i, name, ring: (i, {"place": "city", "name": name}, "polygon", [ring])
    big, small = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)], [(3.0, 3.0), (3.0, 6.0), (6.0, 6.0), (6.0, 3.0)]
    ell = [(1.0, 1.0), (1.0, 9.0), (2.0, 9.0), (2.0, 2.0), (9.0, 2.0), (9.0, 1.0)]  # the mean of its corners is in the small area
    rows = [area(1, "Big", big), area(2, "Small", small), (3, {"building": "yes"}, "polygon", [ell]), (4, {"a": "b"}, "line", [[(4.0, 4.0), (5.0, 8.0)]]), (5, {"a": "b"}, "point", [[(4.0, 4.0)]])]
    df = spark.createDataFrame(rows, f"id int, tags map<string,string>, kind string, rings array<{SHAPE}>")
    got = {r.id: r.tags.get("addr:city") for r in places.enrich(df, {"place=city": "addr:city"}, 1.0).collect()}
    assert got == {1: None, 2: "Big", 3: "Big", 4: "Big", 5: "Small"}
    mid = {r.id: (round(r.lat, 6), round(r.lon, 6)) for r in places.with_box(df).collect()}
    assert mid[3] == (round((8 * 1.5 + 7 * 5.5) / 15, 6), round((8 * 5.0 + 7 * 1.5) / 15, 6)) and mid[4] == (4.5, 6.0) and mid[5] == (4.0, 4.0)
