"""Values as callers write them: lists of map ids, boxes, attribute filters."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First letters of map ids and the tables they name (fixed values).
ID_TYPES = {"R": "relation", "W": "way", "N": "node"}


def map_id(c) -> Column:
    """(type, id) of a text like 'R123', in either case; null stays null, any other text is an error."""
    letter, number = F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 20).try_cast("bigint")
    kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in ID_TYPES.items() for x in pair]), letter)
    wrong = F.raise_error(F.concat(F.lit("not a map id: "), c)).cast("struct<type:string,id:bigint>")
    return F.when(c.isNull(), F.lit(None)).when(kind.isNull() | number.isNull(), wrong).otherwise(F.struct(kind.alias("type"), number.alias("id")))


def map_ids(c) -> Column:
    """The (type, id) pairs of a comma list, of ids that differ only in case one, in order."""
    items = F.filter(F.transform(F.split(c, ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    return F.transform(F.array_distinct(items), map_id)


def parse_box(c) -> Column:
    """(south, west, north, east) of 'a,b,c,d', two corners in any order; null where it is none."""
    parts = F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("double"))
    a, b, d, e = (F.get(parts, F.lit(k)) for k in range(4))
    box = F.struct(F.least(a, d).alias("south"), F.least(b, e).alias("west"), F.greatest(a, d).alias("north"), F.greatest(b, e).alias("east"))
    return F.when(a.isNotNull() & b.isNotNull() & d.isNotNull() & e.isNotNull(), box)


def attribute_objects(text: str | None) -> list[dict[str, str]]:
    """The objects of a filter text: a JSON array of them, or objects without the brackets; anything else filters nothing."""
    if not (text or "").strip():
        return []
    for candidate in (text, f"[{text}]"):
        try:
            objects = json.loads(candidate)
        except ValueError:
            continue
        if isinstance(objects, list) and all(isinstance(o, dict) and all(isinstance(v, str) for v in o.values()) for o in objects):
            return objects
    return []
