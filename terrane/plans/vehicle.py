"""Vehicle profiles as column expressions: access, speed, factor, direction."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import tags as t, units

# Highway classes with the speed of a car on them (km/h) and the divisor of the classification profile.
CAR_SPEEDS = {
    "motorway": 120, "motorway_link": 120, "trunk": 90, "trunk_link": 90, "primary": 90, "primary_link": 90, "secondary": 70, "secondary_link": 70,
    "tertiary": 70, "tertiary_link": 70, "unclassified": 50, "residential": 50, "service": 30, "services": 30, "road": 30, "track": 30, "living_street": 5,
    "ferry": 5, "movable": 5, "shuttle_train": 10, "default": 10,
}
CAR_CLASSES = {
    "motorway": 10, "motorway_link": 10, "trunk": 9, "trunk_link": 9, "primary": 8, "primary_link": 8, "secondary": 7, "secondary_link": 7,
    "tertiary": 6, "tertiary_link": 6, "unclassified": 5, "residential": 5,
}
ACCESS = {"private": False, "yes": True, "no": False, "permissive": True, "destination": True, "customers": False, "designated": True, "public": True, "delivery": True, "use_sidepath": False}


@dataclass(frozen=True)
class Profile:
    """A vehicle's rules. speed_share is the part of a road's own speed that it drives; units: posted speeds may name a unit;
    least and most are its speeds at all, which bound the cost of a metre in searches."""

    name: str
    vehicle_types: tuple[str, ...]
    speeds: dict = field(default_factory=lambda: CAR_SPEEDS)
    speed_share: float = 1.0
    units: bool = True
    least: float = 30
    most: float = 200
    uses_oneway: bool = True
    uses_maxspeed: bool = True
    posted_at_most: float | None = None
    barred: tuple[str, ...] = ()
    own_oneway: str | None = None


# The other vehicles' speeds.
MOPED_SPEEDS = {
    "primary": 40, "primary_link": 40, "secondary": 40, "secondary_link": 40, "tertiary": 40, "tertiary_link": 40, "unclassified": 40, "residential": 40, "service": 30, "services": 30,
    "road": 30, "track": 30, "living_street": 5, "ferry": 5, "movable": 5, "shuttle_train": 10, "default": 10,
}
BICYCLE_SPEEDS = dict.fromkeys(
    "primary primary_link secondary secondary_link tertiary tertiary_link unclassified residential service services road track cycleway path living_street ferry movable shuttle_train default footway pedestrian".split(), 15
)
BICYCLE_BARRED = ("footway", "pedestrian")  # only with access tags of their own
FOOT_SPEEDS = dict.fromkeys(
    "primary primary_link secondary secondary_link tertiary tertiary_link unclassified residential service services road track cycleway path footway pedestrian living_street ferry movable shuttle_train default".split(), 4
) | {"steps": 2}

_MOTOR = ("access", "vehicle", "motor_vehicle", "motorcar")
PROFILES = {
    p.name: p
    for p in (
        Profile("car", _MOTOR, units=False),  # the car of the road graph
        Profile("car_script", _MOTOR, speed_share=0.75),  # the car of the script rules
        Profile("bus", (*_MOTOR, "bus")),
        Profile("bigtruck", _MOTOR),
        Profile("smalltruck", _MOTOR),
        Profile("motorcycle", ("access", "vehicle", "motor_vehicle", "motorcycle")),
        Profile("moped", ("access", "vehicle", "motor_vehicle", "moped"), speeds=MOPED_SPEEDS, least=40, most=40, posted_at_most=40),
        Profile("bicycle", ("access", "vehicle", "bicycle"), speeds=BICYCLE_SPEEDS, least=15, most=15, uses_maxspeed=False, barred=BICYCLE_BARRED, own_oneway="oneway:bicycle"),
        Profile("pedestrian", ("access", "foot"), speeds=FOOT_SPEEDS, least=4, most=5, uses_oneway=False, uses_maxspeed=False),
    )
}


def _lookup(values: dict, key) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), key)


def highway(tags) -> Column:
    """The road class; a ferry route is one whatever its highway says."""
    return F.when(t.get(tags, "route") == "ferry", "ferry").otherwise(t.get(tags, "highway"))


def access(tags, p: Profile) -> Column:
    """The last answer of the vehicle's access keys, from the general to the particular; true if none answers, but on barred roads false."""
    answers = [_lookup(ACCESS, t.get(tags, k)) for k in reversed(p.vehicle_types)]
    return F.coalesce(*answers, ~F.coalesce(highway(tags).isin(*p.barred), F.lit(False)) if p.barred else F.lit(True))


def speed(tags, p: Profile) -> Column:
    base = _lookup({k: float(v) * p.speed_share for k, v in p.speeds.items()}, highway(tags))
    posted = t.get(tags, "maxspeed")
    posted = (units.speed_kmh(posted) if p.units else posted.try_cast("double")) if p.uses_maxspeed else F.lit(None).cast("double")
    posted = F.least(posted, F.lit(p.posted_at_most)) if p.posted_at_most else posted
    return F.when(base.isNotNull() & access(tags, p), F.when(posted.isNotNull() & (posted > 0), posted * 0.75).otherwise(base))


def direction(tags, p: Profile) -> Column:
    """0 both ways, 1 forward, 2 backward; 3 more on roads where one may not stop."""
    if not p.uses_oneway:
        return F.lit(0)
    says = lambda c: F.when(c.isin("yes", "true", "1"), 1).when(c == "-1", 2)
    keys = [k for k in (p.own_oneway, "oneway") if k]
    way = F.coalesce(*[says(t.get(tags, k)) for k in keys], F.when(t.get(tags, "junction") == "roundabout", 1), F.lit(0))
    return way + F.when(highway(tags).isin("motorway", "motorway_link"), 3).otherwise(0)


def factors(tags, p: Profile) -> dict[str, Column]:
    """Seconds a metre, one a metre (shortest), and seconds a metre divided by the road's class."""
    seconds = F.lit(3.6) / speed(tags, p)
    divisor = F.coalesce(_lookup({k: float(v) for k, v in CAR_CLASSES.items()}, highway(tags)), F.lit(4.0))
    return {"fastest": seconds, "shortest": F.when(seconds.isNotNull(), F.lit(1.0)), "classifications": seconds / divisor}


def metre_bounds(p: Profile) -> tuple[float, float]:
    """The least and the most seconds that the vehicle takes for a metre: the first keeps estimates of searches admissible."""
    return 3.6 / p.most, 3.6 / p.least


def can_go(direction_col, forward: bool) -> Column:
    return F.col(direction_col).isin(0, 1, 3, 4) if forward else F.col(direction_col).isin(0, 2, 3, 5)
