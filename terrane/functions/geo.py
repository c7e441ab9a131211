"""Geometry of points, segments and boxes as column expressions. Degrees in, metres out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6371000.0


def haversine(lat1, lon1, lat2, lon2) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * EARTH) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def planar2(lat1, lon1, lat2, lon2) -> Column:
    """Squared distance in degrees."""
    return F.pow(lat1 - lat2, F.lit(2)) + F.pow(lon1 - lon2, F.lit(2))


def angle(lat1, lon1, lat2, lon2, lat3, lon3) -> Column:
    """Degrees at the second of three points in the plane; 180 where a side has no length."""
    ax, ay, bx, by = lon1 - lon2, lat1 - lat2, lon3 - lon2, lat3 - lat2
    size = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(ax * bx + ay * by, size)))
    return F.when(size == 0, F.lit(180.0)).otherwise(F.degrees(F.acos(cosine)))


def valid(lat, lon) -> Column:
    return ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180)


def parse_point(c) -> Column:
    """(lat, lon) of 'lat,lon', null where it is none."""
    parts = F.split(c, ",")
    return F.struct(F.get(parts, F.lit(0)).try_cast("double").alias("lat"), F.get(parts, F.lit(1)).try_cast("double").alias("lon"))


def shift_longitude(lon) -> Column:
    """Longitudes from 0 to 360, for shapes over the date line."""
    return F.when(lon < 0, lon + 360).otherwise(lon)


def normalise_degrees(a) -> Column:
    return F.pmod(a, F.lit(360.0))


def smallest_difference(a, b) -> Column:
    d = F.pmod(a - b, F.lit(360.0))
    return F.when(d > 180, d - 360).otherwise(d)


def offset(lat, lon, metres, bearing_degrees) -> tuple[Column, Column]:
    """The point at a distance and bearing."""
    d, b, p = metres / EARTH, F.radians(bearing_degrees), F.radians(lat)
    lat2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    lon2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(lat2))
    return F.degrees(lat2), F.pmod(F.degrees(lon2) + 540, F.lit(360.0)) - 180


def closest_on_segment(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """(lat, lon, t) of the point of a segment closest in the plane; t is its place from 0 to 1."""
    dx, dy = lon2 - lon1, lat2 - lat1
    t = F.coalesce(F.try_divide((lon - lon1) * dx + (lat - lat1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.struct((lat1 + t * dy).alias("lat"), (lon1 + t * dx).alias("lon"), t.alias("t"))


def to_screen(lat, lon, centre_lat, centre_lon, ratio, width, height) -> tuple[Column, Column]:
    """Pixels (x, y) of an equirectangular view in metres about a centre."""
    x = F.radians(lon - centre_lon) * EARTH * F.cos(F.radians(centre_lat)) * ratio + width / 2
    y = height / 2 - F.radians(lat - centre_lat) * EARTH * ratio
    return x, y


def in_box(lat, lon, south, west, north, east) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def boxes_overlap(a, b) -> Column:
    """Whether two boxes (structs of south, west, north, east) share a point."""
    return (a["south"] <= b["north"]) & (b["south"] <= a["north"]) & (a["west"] <= b["east"]) & (b["west"] <= a["east"])


def resize_box(b, degrees: float) -> Column:
    return F.struct((b["south"] - degrees).alias("south"), (b["west"] - degrees).alias("west"), (b["north"] + degrees).alias("north"), (b["east"] + degrees).alias("east"))


def in_ring(lat, lon, ring: list[tuple[float, float]]) -> Column:
    """Even-odd test of a point against a constant ring of (lat, lon)."""
    crossings = []
    for (y1, x1), (y2, x2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            above = ((F.lit(float(y1)) > lat) & (F.lit(float(y2)) <= lat)) | ((F.lit(float(y2)) > lat) & (F.lit(float(y1)) <= lat))
            crossings.append(F.when(above & (lon < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1), 1).otherwise(0))
    return sum(crossings[1:], crossings[0]) % 2 == 1


def in_rings(lat, lon, rings) -> Column:
    """Even-odd test against a column of rings: array of arrays of (lat, lon). Holes are rings like others."""

    def odd(ring):
        pairs = F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        hit = lambda p: ((p["a"]["lat"] > lat) != (p["b"]["lat"] > lat)) & (
            lon < (lat - p["a"]["lat"]) * F.try_divide(p["b"]["lon"] - p["a"]["lon"], p["b"]["lat"] - p["a"]["lat"]) + p["a"]["lon"]
        )
        return F.size(F.filter(pairs, hit)) % 2

    return F.coalesce(F.aggregate(F.transform(rings, odd), F.lit(0), lambda x, y: x + y) % 2 == 1, F.lit(False))


def ring_area(ring) -> Column:
    """Signed shoelace area of a ring in square degrees."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, after, lambda a, b: a["lon"] * b["lat"] - b["lon"] * a["lat"])
    return F.aggregate(terms, F.lit(0.0), lambda x, y: x + y) / 2


def line_length(points) -> Column:
    """Metres along an array of (lat, lon)."""
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), lambda a, b: haversine(a["lat"], a["lon"], b["lat"], b["lon"]))
    return F.aggregate(steps, F.lit(0.0), lambda x, y: x + y)


def segments_cross(lat1, lon1, lat2, lon2, lat3, lon3, lat4, lon4) -> Column:
    """(lat, lon) where two segments cross in the plane, else null; parallel ones do not."""
    dy1, dx1, dy2, dx2 = lat2 - lat1, lon2 - lon1, lat4 - lat3, lon4 - lon3
    size = dx1 * dy2 - dy1 * dx2
    t = F.try_divide((lon3 - lon1) * dy2 - (lat3 - lat1) * dx2, size)
    u = F.try_divide((lon3 - lon1) * dy1 - (lat3 - lat1) * dx1, size)
    return F.when(t.between(0, 1) & u.between(0, 1), F.struct((lat1 + t * dy1).alias("lat"), (lon1 + t * dx1).alias("lon")))


def crossing_parts(lat1, lon1, dy1, dx1, lat2, lon2, dy2, dx2) -> tuple[Column, Column, Column]:
    """(whole, t, u) of two segments, each a start and a step: they cross at the shares t / whole of the first and u / whole of the second."""
    return dx1 * dy2 - dy1 * dx2, (lon2 - lon1) * dy2 - (lat2 - lat1) * dx2, (lon2 - lon1) * dy1 - (lat2 - lat1) * dx1


def may_be_share(part, whole) -> Column:
    """Whether part / whole is from 0 to 1, without the division: true for all that are, whatever the rounding."""
    return (part * whole >= 0) & (F.abs(part) <= F.abs(whole) * (1 + 1e-12))


def along(lat1, lon1, lat2, lon2, metres) -> Column:
    """(lat, lon) at a distance along a segment, by share of its length."""
    t = F.coalesce(F.try_divide(metres, haversine(lat1, lon1, lat2, lon2)), F.lit(0.0))
    return F.struct((lat1 + t * (lat2 - lat1)).alias("lat"), (lon1 + t * (lon2 - lon1)).alias("lon"))


def along_line(points, metres) -> Column:
    """(lat, lon) at a distance along an array of points: the first step whose end is as far, then its share. Before the start and after the end the end itself; null without points."""
    n = F.size(points)
    steps = F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: haversine(a["lat"], a["lon"], b["lat"], b["lon"]))
    sums = F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, d: F.array_append(acc, F.element_at(acc, -1) + d))

    def place(x):
        after = F.size(F.filter(x, lambda s: s < metres))  # sums do not fall, so as many stand before the place
        k = F.greatest(F.lit(1), F.least(after, F.size(x) - 1))
        a, b, part = F.get(points, k - 1), F.get(points, k), F.get(x, k) - F.get(x, k - 1)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(metres - F.get(x, k - 1), part), F.lit(0.0))))
        return F.when(n > 1, F.struct((a["lat"] + t * (b["lat"] - a["lat"])).alias("lat"), (a["lon"] + t * (b["lon"] - a["lon"])).alias("lon"))).when(n == 1, F.struct(F.get(points, F.lit(0))["lat"].alias("lat"), F.get(points, F.lit(0))["lon"].alias("lon")))

    return F.transform(F.array(sums), place)[0]


def offset_both(lat, lon, north, east) -> tuple[Column, Column]:
    """The point that many metres north and east."""
    up, _ = offset(lat, lon, north, F.lit(0.0))
    _, over = offset(lat, lon, east, F.lit(90.0))
    return up, over


def rings_area(rings) -> Column:
    """Square degrees inside rings that do not cross, under the even-odd rule: a ring in an odd number of others is a hole."""
    middle = lambda r: F.struct(((r[0]["lat"] + r[1]["lat"]) / 2).alias("lat"), ((r[0]["lon"] + r[1]["lon"]) / 2).alias("lon"))

    def signed(r, i):
        m = middle(r)
        around = F.filter(rings, lambda s, j: (j != i) & in_rings(m["lat"], m["lon"], F.array(s)))
        return F.when(F.size(around) % 2 == 0, F.abs(ring_area(r))).otherwise(-F.abs(ring_area(r)))

    return F.aggregate(F.transform(rings, signed), F.lit(0.0), lambda x, y: x + y)


def box_centre(b) -> Column:
    return F.struct(((b["south"] + b["north"]) / 2).alias("lat"), ((b["west"] + b["east"]) / 2).alias("lon"))


def box_with(b, lat, lon) -> Column:
    """A box grown to hold a point."""
    return F.struct(F.least(b["south"], lat).alias("south"), F.least(b["west"], lon).alias("west"), F.greatest(b["north"], lat).alias("north"), F.greatest(b["east"], lon).alias("east"))


def box_ring(b) -> Column:
    """A box as a closed ring, from its south-west corner round by the south-east."""
    p = lambda y, x: F.struct(b[y].alias("lat"), b[x].alias("lon"))
    return F.array(p("south", "west"), p("south", "east"), p("north", "east"), p("north", "west"), p("south", "west"))


def in_rings_over_date_line(lat, lon, rings) -> Column:
    """in_rings of rings that may lie over the date line: where their longitudes span more than half the globe, all are taken from 0 to 360."""
    return F.when(over_date_line(rings), in_rings(lat, shift_longitude(lon), shift_rings(rings))).otherwise(in_rings(lat, lon, rings))


def over_date_line(rings) -> Column:
    """Whether the longitudes of rings span more than half the globe."""
    lons = F.transform(F.flatten(rings), lambda p: p["lon"])
    return F.coalesce(F.array_max(lons) - F.array_min(lons) > 180, F.lit(False))


def shift_rings(rings) -> Column:
    """Rings with longitudes from 0 to 360."""
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p["lat"].alias("lat"), shift_longitude(p["lon"]).alias("lon"))))
