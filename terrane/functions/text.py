"""Text expressions: folding, natural sort keys, slugs, pattern translation, titles."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold_yo(c) -> Column:
    """ё and Ё as е and Е."""
    return F.translate(c, "ёЁ", "еЕ")


def natural_key(c, width: int = 12) -> Column:
    """A sort key in which every run of digits is padded with zeros to `width`."""
    parts = F.split(F.regexp_replace(c, r"(\d+)", "\u0001$1\u0001"), "\u0001")
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$") & (F.length(p) < width), F.lpad(p, width, "0")).otherwise(p)), "")


def slug(c) -> Column:
    """Lower case without anything but letters, digits and underscores of any script."""
    return F.lower(F.regexp_replace(c, r"(?U)\W+", ""))


def similar_to(pattern: str) -> str:
    """A SIMILAR TO pattern as an anchored regular expression: % is any run, _ any character."""
    out = []
    for ch in pattern:
        out.append(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) if ch in ".^$\\" else ch)
    return "^(?:" + "".join(out) + ")$"


def present(c) -> Column:
    """The text, or null where it is blank."""
    return F.nullif(F.trim(c), F.lit(""))


def joined(separator: str, *parts) -> Column:
    """Parts that are neither null nor blank, with a separator."""
    return F.concat_ws(separator, *[present(p) for p in parts])


def house_title(name, number, block, structure) -> Column:
    """Type, number, block and structure of a house; the latter two with their letters before them."""
    return joined(" ", name, number, F.concat(F.lit("к"), present(block)), F.concat(F.lit("с"), present(structure)))


def room_title(flat, room, separator: str = ", ") -> Column:
    return F.concat_ws(separator, F.concat(F.lit("Квартира "), present(flat)), F.concat(F.lit("Комната "), present(room)))


def stead_title(number) -> Column:
    return F.concat(F.lit("уч. "), present(number))


def object_title(level, type_name, name) -> Column:
    """Type and name below the first level; the name alone on it."""
    return F.when(level > 1, joined(" ", type_name, name)).otherwise(name)


def part_count(title) -> Column:
    """Comma-separated parts: the priority of a registry title."""
    return F.size(F.split(title, ","))


def with_postcode(postcode, own, inherited, address) -> Column:
    code = F.coalesce(present(own), present(inherited)) if postcode else F.lit(None).cast("string")
    return F.concat_ws(", ", code, address)


def replace_words(c, wordforms: dict[str, str]) -> Column:
    """Whole lower-cased words by a dictionary of word forms; other words and the blanks between stay."""
    forms = F.create_map(*[F.lit(x) for kv in sorted(wordforms.items()) for x in kv])
    return F.array_join(F.transform(F.split(F.lower(fold_yo(c)), r"\s+"), lambda w: F.coalesce(F.try_element_at(forms, w), w)), " ")


# Short forms of address words.
WORDFORMS = {
    "ул.": "улица", "пр-д": "проезд", "ш.": "шоссе", "респ.": "республика", "наб.": "набережная", "пл.": "площадь", "рп.": "рабочий посёлок", "д.": "деревня", "г.": "город",
    "обл.": "область", "пгт": "посёлок городского типа", "пр-кт": "проспект", "пр-т": "проспект", "р-н": "район", "пер.": "переулок", "с.": "село",
}
