"""Registry search documents: full addresses of objects, houses, rooms and plots, from either registry's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import hierarchy
from ..operators.changes import valid_at

COLUMNS = ["guid", "parent", "title", "postcode", "building"]


def fias_objects(addrob: DataFrame, socrbase: DataFrame, formal: bool = False, socr: bool = True) -> DataFrame:
    """(guid, parent, title, postcode, building) of live address objects; type names by (short name, level)."""
    live = addrob.where("livestatus = 1")
    types = socrbase.select(F.col("scname").alias("shortname"), F.col("level").alias("aolevel"), "socrname")
    j = live.join(F.broadcast(types) if types.count() <= 10_000 else types, ["shortname", "aolevel"])
    kind = F.col("socrname") if socr else F.col("shortname")
    name = F.coalesce(tx.present(F.col("formalname" if formal else "offname")), F.col("offname" if formal else "formalname"))
    return j.select(F.col("aoguid").alias("guid"), F.col("parentguid").alias("parent"), tx.object_title(F.col("aolevel"), kind, name).alias("title"), F.lit(None).cast("string").alias("postcode"), F.lit(0).alias("building"))


def fias_houses(house: DataFrame, eststat: DataFrame, now) -> DataFrame:
    """Houses valid at an instant; they inherit postcodes."""
    j = valid_at(house, "startdate", "enddate", now).join(eststat.select(F.col("eststatid").alias("eststatus"), "name"), "eststatus")
    return j.select(F.col("houseguid").alias("guid"), F.col("aoguid").alias("parent"), tx.house_title(F.col("name"), F.col("housenum"), F.col("buildnum"), F.col("strucnum")).alias("title"), F.coalesce(F.col("postalcode"), F.lit("")).alias("postcode"), F.lit(1).alias("building"))


def fias_rooms(room: DataFrame, separator: str = " ") -> DataFrame:
    live = room.where("livestatus = 1")
    return live.select(F.col("roomguid").alias("guid"), F.col("houseguid").alias("parent"), tx.room_title(F.col("flatnumber"), F.col("roomnumber"), separator).alias("title"), F.coalesce(F.col("postalcode"), F.lit("")).alias("postcode"), F.lit(2).alias("building"))


def fias_steads(stead: DataFrame) -> DataFrame:
    live = stead.where("livestatus = 1")
    return live.select(F.col("steadguid").alias("guid"), F.col("parentguid").alias("parent"), tx.stead_title(F.col("number")).alias("title"), F.lit(None).cast("string").alias("postcode"), F.lit(1).alias("building"))


def gar_level(rows: DataFrame, links: DataFrame, title, building: int, id_col: str = "OBJECTID") -> DataFrame:
    """(guid, parent, title, postcode, building) of one of the other registry's tables and its hierarchy; only active, actual rows.

    Ids are compared as numbers, also where a table keeps them as text.
    """
    active = rows.where("ISACTUAL = 1 and ISACTIVE = 1").withColumn("__id", F.col(id_col).try_cast("bigint"))
    up = links.where("ISACTIVE = 1").select(F.col("OBJECTID").try_cast("bigint").alias("__id"), F.col("PARENTOBJID").try_cast("bigint").cast("string").alias("parent"))
    return active.join(up, "__id", "left").select(F.col("__id").cast("string").alias("guid"), "parent", title.alias("title"), F.lit(None).cast("string").alias("postcode"), F.lit(building).alias("building"))


def gar_objects(objects: DataFrame, types: DataFrame, links: DataFrame) -> DataFrame:
    """gar_level of address objects: the type's name, found by short name and level, before the object's; without a type the name alone."""
    kinds = types.groupBy(F.col("SHORTNAME").alias("TYPENAME"), "LEVEL").agg(F.min("NAME").alias("__type"))
    return gar_level(objects.join(kinds, ["TYPENAME", "LEVEL"], "left"), links, tx.joined(" ", F.col("__type"), F.col("NAME")), 0)


def gar_numbered(rows: DataFrame, links: DataFrame, number: str, building: int, types: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """gar_level of houses, rooms, plots or parking places: the name of the type (types: ID, NAME) under a column, if there is one, before the number."""
    if types is None:
        return gar_level(rows, links, tx.present(F.col(number)), building)
    kinds = types.groupBy(F.col("ID").alias("__kind")).agg(F.min("NAME").alias("__type"))
    return gar_level(rows.join(kinds, rows[kind] == kinds["__kind"], "left"), links, tx.joined(" ", F.col("__type"), F.col(number)), building)


def documents(levels: list[DataFrame], depth: int = 12) -> DataFrame:
    """Index rows (guid, title, priority, building) of all levels together.

    A title is that of all ancestors and the row, comma-joined; a row with a
    postcode column (houses and rooms) has its own or its nearest ancestor's in
    front. Ancestors that are not there are left out.
    """
    rows = levels[0].select(*COLUMNS)
    for more in levels[1:]:
        rows = rows.unionByName(more.select(*COLUMNS))
    rows = rows.groupBy("guid").agg(F.max_by(F.struct("parent", "title", "postcode", "building"), F.struct("building", "title", "parent")).alias("r")).select("guid", "r.*")
    full = hierarchy.full_titles(rows, "guid", "parent", "title", depth)
    chain = hierarchy.full_titles(rows.select("guid", "parent", tx.present(F.col("postcode")).alias("code")), "guid", "parent", "code", depth, "\n").select("guid", F.col("full_title").alias("codes"))
    coded = full.join(chain, "guid")
    code = F.when(F.col("postcode").isNotNull(), tx.present(F.substring_index("codes", "\n", -1)))
    return coded.select("guid", F.concat_ws(", ", code, F.col("full_title")).alias("title"), "building").withColumn("priority", tx.part_count(F.col("title")))
