"""Expressions over tag bags (maps of strings)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_json_map(c) -> Column:
    return F.from_json(c, "map<string,string>")


def has_key(tags, key: str) -> Column:
    return F.coalesce(F.map_contains_key(tags, F.lit(key)), F.lit(False))


def has_any_key(tags, keys: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.map_keys(tags), F.array(*map(F.lit, keys))), F.lit(False))


def get(tags, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def keys_with_prefix(tags, prefix: str) -> Column:
    return F.filter(F.map_keys(tags), lambda k: k.startswith(prefix))


def distinct_keys(df: DataFrame, tags: str) -> DataFrame:
    """(key) of all rows' tags."""
    return df.select(F.explode(F.map_keys(tags)).alias("key")).distinct()


def name_or_ref(tags) -> Column:
    """The name where the key is there (even if its value is null), else the ref."""
    return F.when(has_key(tags, "name"), get(tags, "name")).otherwise(get(tags, "ref"))


def is_true(c) -> Column:
    return F.coalesce(F.lower(c).isin("yes", "true", "1"), F.lit(False))


def is_false(c) -> Column:
    return F.coalesce(F.lower(c).isin("no", "false", "0"), F.lit(False))


def first_present(tags, keys: list[str]) -> Column:
    return F.coalesce(*[get(tags, k) for k in keys])


def last_index_present(tags, keys: list[str]) -> Column:
    """1-based place of the last key of a list that the tags have; 0 if none."""
    return F.greatest(F.lit(0), *[F.when(has_key(tags, k), i + 1).otherwise(0) for i, k in enumerate(keys)])


def same_tags(a, b, exclude: tuple = ()) -> Column:
    """Whether two bags hold the same pairs, some keys aside."""
    pairs = lambda m: F.array_sort(F.map_entries(F.map_filter(m, lambda k, v: ~k.isin(*exclude) if exclude else F.lit(True))))
    return pairs(a) == pairs(b)


def merge_maps(df: DataFrame, by: list[str], key: str, value: str, rank: list | None = None, name: str = "tags") -> DataFrame:
    """One map per group from (key, value) rows. Of equal keys the row first by rank, then by value, wins.

    Rows are reduced to one per (group, key) with partial aggregates before the
    map is built, so a hot group is bounded by its distinct keys.
    """
    order = F.struct(*[F.col(r) for r in (rank or [])], F.col(value))
    one = df.groupBy(*by, key).agg(F.min_by(value, order).alias(value))
    return one.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias(name))


def append_to_list(value, item) -> Column:
    """A comma list with an item more, if it is not in it yet."""
    return F.when(value.isNull() | (value == ""), item).otherwise(F.array_join(F.array_union(F.split(value, ","), F.array(item)), ","))
