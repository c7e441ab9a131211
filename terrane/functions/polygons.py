"""Union and difference of polygons as sets of rings under the even-odd rule, by a scan line.

The plane is cut into strips at every corner and crossing, so the edges in a strip do not
cross and stand in one order. Going up a strip, what is inside of either
polygon toggles; where the combined inside changes, an edge of the result runs. Edges that
touch, overlap or repeat need no cases of their own.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain

import numpy as np

#: Digits of a degree to which points count as one (a tenth of a millimetre).
DIGITS = 9
UNION, DIFFERENCE = (lambda a, b: a or b), (lambda a, b: a and not b)


def _edges(rings_a: list, rings_b: list) -> np.ndarray:
    """[x1, y1, x2, y2, owner] of the edges that are not upright, x1 < x2, by x1. Rings are lists of (lat, lon)."""
    rows = []
    for owner, rings in enumerate((rings_a, rings_b)):
        for ring in rings:
            pts = [(round(x, DIGITS), round(y, DIGITS)) for y, x in ring]
            for p, q in zip(pts, pts[1:] + pts[:1]):
                if p[0] != q[0]:
                    rows.append((*min(p, q), *max(p, q), owner))
    return np.array(sorted(rows), dtype=float).reshape(-1, 5)


def _at(e: np.ndarray, k: np.ndarray, x) -> np.ndarray:
    """y of edges at x, exact at their ends."""
    y = e[k, 1] + (e[k, 3] - e[k, 1]) / (e[k, 2] - e[k, 0]) * (x - e[k, 0])
    return np.round(np.where(x == e[k, 0], e[k, 1], np.where(x == e[k, 2], e[k, 3], y)), DIGITS)


def _crossings(e: np.ndarray) -> set[tuple]:
    """(x, y) of all places where two edges cross, as each of the two has it; edges are met by their spans of x, then of y."""
    found: set[tuple] = set()
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    ends = np.searchsorted(e[:, 0], e[:, 2], side="left")
    for i in range(len(e)):
        j = np.arange(i + 1, ends[i])
        j = j[(low[j] <= high[i]) & (high[j] >= low[i]) & (slope[j] != slope[i])]
        if len(j):
            x = np.round(((e[j, 1] - slope[j] * e[j, 0]) - (e[i, 1] - slope[i] * e[i, 0])) / (slope[i] - slope[j]), DIGITS)
            on = (x >= e[j, 0]) & (x <= np.minimum(e[j, 2], e[i, 2]))
            j, x = j[on], x[on]
            for ys in (_at(e, j, x), _at(e, np.full(len(j), i), x)):
                found.update(zip(x.tolist(), ys.tolist()))
    return found


def combine(rings_a: list, rings_b: list, keep=UNION) -> list:
    """Closed rings of (lat, lon) of a union (or difference). Rings need not be closed; holes come as rings of their own."""
    e = _edges(rings_a, rings_b)
    if not len(e):
        return []
    met = _crossings(e)
    xs = sorted({*e[:, 0].tolist(), *e[:, 2].tolist(), *(x for x, _ in met)})
    corners = {(round(x, DIGITS), round(y, DIGITS)) for r in chain(rings_a, rings_b) for y, x in r} | met
    links: dict[tuple, list] = defaultdict(list)
    active, begun, before = np.empty(0, dtype=int), 0, []

    def link(p, q):
        if p != q:
            links[p].append(q)
            links[q].append(p)

    def upright(x, left, right):
        ends = sorted(left + right)
        for y1, y2 in zip(ends[::2], ends[1::2]):  # inside on one side only
            corners.update(((x, y1), (x, y2)))
            cuts = sorted({y1, y2, *(y for y in corners_at.get(x, ()) if y1 < y < y2)})
            for p, q in zip(cuts, cuts[1:]):
                link((x, p), (x, q))

    corners_at: dict[float, list] = defaultdict(list)
    for x, y in corners:
        corners_at[x].append(y)
    for left, right in zip(xs, xs[1:]):
        to = int(np.searchsorted(e[:, 0], left, side="right"))
        active = np.concatenate([active[e[active, 2] > left], np.arange(begun, to)[e[begun:to, 2] > left]])
        begun = to
        ya, yb = _at(e, active, left), _at(e, active, right)
        order = np.lexsort((yb, ya, ya + yb))
        inside, on, k, lower, upper = [False, False], False, 0, [], []
        rows = list(zip(ya[order].tolist(), yb[order].tolist(), e[active[order], 4].astype(int).tolist()))
        while k < len(rows):
            a, b = rows[k][:2]
            while k < len(rows) and rows[k][:2] == (a, b):  # edges on one another
                inside[rows[k][2]] = not inside[rows[k][2]]
                k += 1
            if keep(*inside) != on:
                on = not on
                lower.append(a)
                upper.append(b)
                link((left, a), (right, b))
        upright(left, before, lower)
        before = upper
    upright(xs[-1], before, [])
    return _walk(links, corners)


def _walk(links: dict, corners: set) -> list:
    """Rings along links; every point has an even number of them. Points that only a strip made are left out."""
    rings = []
    for start in list(links):
        while links[start]:
            ring, p = [start], start
            while True:
                q = links[p].pop()
                links[q].remove(p)
                p = q
                if p == start:
                    break
                ring.append(p)
            ring = [p for p in ring if p in corners]
            if len(ring) > 2:
                rings.append([(y, x) for x, y in [*ring, ring[0]]])
    return rings


def fold(runs: list[tuple[str, list]]) -> list:
    """The area of runs of (role, rings) in order: an outer one is added, an inner one taken away."""
    area: list = []
    for role, rings in runs:
        whole: list = []
        for ring in rings:  # rings of one run may overlap as well
            whole = combine(whole, [ring], UNION)
        area = combine(area, whole, UNION if role == "outer" else DIFFERENCE)
    return area
