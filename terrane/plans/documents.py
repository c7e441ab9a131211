"""Search documents from tag bags: titles, priorities, alternatives, flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags as t
from ..functions.text import natural_key, present

# The keys that a title names, from the widest place to the narrowest, each with what stands before its value.
TITLE_KEYS = (
    ("addr:postcode", ""),
    ("addr:region", ""),
    ("addr:peninsula", ""),
    ("addr:district", ""),
    ("addr:city", ""),
    ("addr:town", ""),
    ("addr:village", ""),
    ("addr:municipality", ""),
    ("addr:subdistrict", ""),
    ("addr:landuse", ""),
    ("addr:suburb", ""),
    ("addr:hamlet", ""),
    ("addr:allotments", ""),
    ("addr:isolated_dwelling", ""),
    ("addr:neighbourhood", ""),
    ("addr:locality", ""),
    ("addr:place", ""),
    ("addr:quarter", ""),
    ("addr:island", ""),
    ("addr:islet", ""),
    ("addr:highway:yes", ""),
    ("addr:highway:motorway", ""),
    ("addr:highway:service", ""),
    ("addr:highway:track", ""),
    ("addr:highway:trunk", ""),
    ("addr:highway:primary", ""),
    ("addr:highway:secondary", ""),
    ("addr:highway:tertiary", ""),
    ("addr:highway:unclassified", ""),
    ("addr:highway:residential", ""),
    ("addr:highway:footway", ""),
    ("addr:highway:cycleway", ""),
    ("addr:highway:path", ""),
    ("addr:highway:road", ""),
    ("addr:highway:living_street", ""),
    ("addr:highway:pedestrian", ""),
    ("addr:highway:construction", ""),
    ("addr:highway:proposed", ""),
    ("addr:highway:raceway", ""),
    ("addr:highway:elevator", ""),
    ("addr:highway:corridor", ""),
    ("addr:highway:services", ""),
    ("addr:highway:steps", ""),
    ("addr:highway:motorway_link", ""),
    ("addr:highway:service_link", ""),
    ("addr:highway:track_link", ""),
    ("addr:highway:trunk_link", ""),
    ("addr:highway:primary_link", ""),
    ("addr:highway:secondary_link", ""),
    ("addr:highway:tertiary_link", ""),
    ("addr:railway:rail", "ж/д"),
    ("addr:railway:tram", "т/п"),
    ("addr:railway:subway", "метро"),
    ("addr:railway:monorail", "монорельс"),
    ("addr:railway:funicular", "фуникулёр"),
    ("addr:railway:razed", ""),
    ("addr:railway:construction", ""),
    ("addr:railway:preserved", ""),
    ("addr:railway:proposed", ""),
    ("addr:railway:yard", ""),
    ("addr:railway:service_station", ""),
    ("addr:bridge", "мост"),
    ("addr:tunnel", "туннель"),
    ("addr:street", ""),
    ("addr:square", ""),
    ("addr:housenumber", ""),
    ("addr:building", ""),
    ("addr:station", "станция"),
    ("addr:platform", "платформа"),
    ("addr:highway:stop", "остановка"),
    ("addr:railway:stop", "остановка"),
    ("addr:highway:bus_stop", "остановка"),
    ("addr:railway:tram_stop", "остановка"),
    ("addr:railway:halt", "остановка по требованию"),
    ("addr:highway:halt", "остановка по требованию"),
    ("addr:railway:subway_entrance", "станция"),
    ("addr:railway:station", "станция"),
    ("addr:highway:station", "станция"),
    ("addr:railway:platform", "платформа"),
    ("addr:highway:platform", "платформа"),
    ("addr:man_made", ""),
    ("addr:natural", ""),
    ("addr:shop", ""),
)
# The keys of a building's own title.
BUILDING_KEYS = (
    "addr:region",
    "addr:city",
    "addr:town",
    "addr:village",
    "addr:street",
    "addr:square",
    "addr:housenumber",
)
# Keys that make a document one of its own level.
LEVEL_KEYS = (
    "highway",
    "railway",
    "building",
    "addr:housenumber",
    "addr:building",
    "addr:man_made",
    "addr:natural",
    "addr:shop",
)
LEVELS = [key for key, _ in TITLE_KEYS]
BEFORE = {key: before for key, before in TITLE_KEYS if before}


def title(tags, keys: list[str] = LEVELS) -> Column:
    """Present values in the order of keys, each with what stands before it, without repeats that differ only in case, comma-joined.

    Only keys that the bag has are looked up, so neither the expression's size nor a
    row's cost is that of the whole list.
    """
    names = F.coalesce(F.array_intersect(F.array(*[F.lit(k) for k in keys]), F.map_keys(tags)), F.array().cast("array<string>"))
    heads = [F.lit(x) for k in dict.fromkeys(keys) if k in BEFORE for x in (k, BEFORE[k] + " ")]
    head = (lambda k: F.coalesce(F.try_element_at(F.create_map(*heads), k), F.lit(""))) if heads else (lambda k: F.lit(""))
    values = F.transform(names, lambda k: F.concat(head(k), present(F.try_element_at(tags, k))))
    values = F.filter(values, lambda v: v.isNotNull())
    start = F.array().cast("array<string>")
    unique = F.aggregate(values, start, lambda acc, v: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(v)), acc).otherwise(F.concat(acc, F.array(v))))
    return F.array_join(unique, ", ")


def alternatives(tags) -> Column:
    """' / street, square, number' for each numbered address that differs from the main one.

    What a numbered address leaves out is as in the main one.
    """
    parts = ("street", "square", "housenumber")
    numbered = F.array_sort(F.filter(F.map_keys(tags), lambda k: k.rlike(r"^addr\d+:housenumber$")))
    part = lambda p, name: F.try_element_at(tags, F.concat(p, F.lit(f":{name}")))
    of = lambda p: F.struct(*[F.coalesce(part(p, n), t.get(tags, f"addr:{n}")).alias(n) for n in parts])
    main = F.struct(*[t.get(tags, f"addr:{n}").alias(n) for n in parts])
    lower = lambda s: F.struct(*[F.lower(s[n]).alias(n) for n in parts])
    others = F.filter(F.transform(numbered, lambda k: of(F.substring_index(k, ":", 1))), lambda s: ~lower(s).eqNullSafe(lower(main)))
    return F.array_join(F.transform(others, lambda s: F.concat(F.lit(" / "), F.concat_ws(", ", *[s[n] for n in parts]))), "")


def priority(tags, keys: list[str] = LEVELS) -> Column:
    """1-based place of the last key of a list that the tags have; 0 if none."""
    back = F.array(*[F.lit(k) for k in reversed(keys)])
    last = F.try_element_at(F.array_intersect(back, F.map_keys(tags)), F.lit(1))  # the bag is read once, outside of any lambda
    return F.coalesce(len(keys) + 1 - F.array_position(back, last).cast("int"), F.lit(0))


def custom_title(tags) -> Column:
    """Of buildings the seven main keys' values, then the name."""
    own = F.when(t.has_key(tags, "building"), F.array(*[t.get(tags, k) for k in BUILDING_KEYS])).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array_join(F.array_compact(F.concat(own, F.array(t.get(tags, "name")))), ", "), alternatives(tags))


def address_documents(addrx: DataFrame) -> DataFrame:
    """Index rows (id, title, custom_title, sorting, custom_sorting, custom_level, priority, building, lat, lon, data) of enriched places."""
    rows = addrx.select("id", "lat", "lon", F.col("tags").alias("data"), F.concat(title(F.col("tags")), alternatives(F.col("tags"))).alias("title"), custom_title(F.col("tags")).alias("custom_title"))
    return rows.select(
        "id", "title", "custom_title", natural_key(F.col("title")).alias("sorting"), natural_key(F.col("custom_title")).alias("custom_sorting"), t.has_any_key(F.col("data"), LEVEL_KEYS).cast("int").alias("custom_level"),
        priority(F.col("data")).alias("priority"), t.has_key(F.col("data"), "building").cast("int").alias("building"), "lat", "lon", "data",
    )


def documents_of(enriched: DataFrame, places: DataFrame) -> DataFrame:
    """Index rows of enriched tags (id, tags) at the middles of their places (id, kind, rings); ids without a place have none."""
    from .places import with_box

    return address_documents(enriched.join(with_box(places.select("id", "kind", "rings")).select("id", "lat", "lon"), "id"))
