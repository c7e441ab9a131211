"""Queries over the driver's tables and the SQL they are held against.

The tables stand in for registries and maps: region, nation, customer and orders
are four levels of a hierarchy, events carry tag bags, keys give coordinates.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import geo, requests, tags as tg, units
from .functions import text as tx
from .operators import changes, containment, crossings, hierarchy, rounds, snapping, spatial
from .plans import documents as docs_plan
from .plans import graph, maps, places, registry as registers, render, routing, search, stitch, vehicle
from .streaming import kept

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


#: Road classes that stand-in roads take by their number.
_HW = ["motorway", "primary", "residential", "service", "footway"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat_of(key: str):
    return ((F.col(key) * 37) % 17000).cast("double") / 100 - 85


def lon_of(key: str):
    return ((F.col(key) * 91) % 36000).cast("double") / 100 - 180


def LAT(key: str) -> str:
    return f"(cast(({key} * 37) % 17000 as double) / 100 - 85)"


def LON(key: str) -> str:
    return f"(cast(({key} * 91) % 36000 as double) / 100 - 180)"


def HAV(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(2 * 6371000.0 * atan2(sqrt({h}), sqrt(1 - {h})))"


# ---- registry ---------------------------------------------------------------------------------------------------------


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, parent, level, type, name): regions, nations, customers."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(1).alias("level"), F.lit("region").alias("type"), F.col("r_name").alias("name"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), F.lit(2), F.lit("nation"), F.col("n_name"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), F.lit(3), F.lit("customer"), F.col("c_name"))
    return r.union(n).union(c)


REGISTRY_SQL = """
reg as (
  select 'R' || r_regionkey as id, cast(null as varchar) as parent, 1 as level, 'region' as type, r_name as name from region
  union all select 'N' || n_nationkey, 'R' || n_regionkey, 2, 'nation', n_name from nation
  union all select 'C' || c_custkey, 'N' || c_nationkey, 3, 'customer', c_name from customer)"""
TITLE_SQL = "case when level > 1 then type || ' ' || name else name end"


@query(f"""with recursive {REGISTRY_SQL},
up as (select id, parent, {TITLE_SQL} as full_title, 1 as levels from reg where parent is null
  union all select r.id, r.parent, u.full_title || ', ' || case when r.level > 1 then r.type || ' ' || r.name else r.name end, u.levels + 1 from reg r join up u on r.parent = u.id)
select id, full_title, cast(levels as integer) as levels, cast(len(string_split(full_title, ',')) as integer) as priority from up""")
def registry_full_title(spark, sf_dir):
    reg = registry(spark, sf_dir).withColumn("title", tx.object_title(F.col("level"), F.col("type"), F.col("name")))
    out = hierarchy.full_titles(reg, "id", "parent", "title", depth=4)
    return out.select("id", "full_title", "levels", tx.part_count(F.col("full_title")).alias("priority"))


@query(f"""with recursive {REGISTRY_SQL},
up as (select id as start_id, id, parent, 0 as level from reg where type = 'customer'
  union all select u.start_id, r.id, r.parent, u.level + 1 from up u join reg r on u.parent = r.id)
select u.start_id, cast(u.level as integer) as level, u.id, r.name from up u join reg r on u.id = r.id""")
def registry_details(spark, sf_dir):
    reg = registry(spark, sf_dir)
    chain = hierarchy.ancestors(reg, reg.where("type = 'customer'"), "id", "parent", depth=3)
    return chain.join(reg.select("id", "name"), "id").select("start_id", "level", "id", "name")


@query(f"with {REGISTRY_SQL} select id, name from reg where parent = 'R1'")
def registry_children(spark, sf_dir):
    return hierarchy.children(registry(spark, sf_dir), "parent", "R1").select("id", "name")


@query(f"with {REGISTRY_SQL} select id, name from reg r where not exists (select 1 from reg p where p.id = r.parent)")
def registry_roots(spark, sf_dir):
    return hierarchy.roots(registry(spark, sf_dir), "id", "parent").select("id", "name")


@query(f"with {REGISTRY_SQL} select id, name from reg r where not exists (select 1 from reg c where c.parent = r.id)")
def registry_leaves(spark, sf_dir):
    return hierarchy.leaves(registry(spark, sf_dir), "id", "parent").select("id", "name")


@query("""with t as (select distinct p_type as scname, 'T-' || p_type as socrname from part where p_size % 2 = 0)
select p_partkey, p_name, coalesce(socrname, p_type) as type_name, socrname is not null as known from part left join t on p_type = scname""")
def object_type_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    types = part.where("p_size % 2 = 0").select(F.col("p_type").alias("scname"), F.concat(F.lit("T-"), F.col("p_type")).alias("socrname")).distinct()
    return part.join(types, part["p_type"] == types["scname"], "left").select("p_partkey", "p_name", F.coalesce("socrname", "p_type").alias("type_name"), F.col("socrname").isNotNull().alias("known"))


@query("select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by o_orderstatus")
def shard_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    shards = [o.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")]
    every = shards[0].unionByName(shards[1]).unionByName(shards[2])
    return every.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select o_orderkey, o_custkey from orders where o_orderdate <= timestamp '1995-06-01' and timestamp '1995-06-01' < o_orderdate + interval 90 day")
def valid_at(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("ends", F.col("o_orderdate") + F.expr("interval 90 days"))
    return changes.valid_at(o, "o_orderdate", "ends", F.expr("timestamp_ntz '1995-06-01'")).select("o_orderkey", "o_custkey")


@query("select c_nationkey, count(*) as n from customer where c_nationkey in (3, 7, 11) group by c_nationkey")
def region_prune(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.col("c_nationkey").isin(3, 7, 11)).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


# ---- tags -------------------------------------------------------------------------------------------------------------


def bags(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("tags", tg.from_json_map(F.col("props")))


@query("select event_id from events where list_has_any(json_keys(props), ['k', 'name'])")
def tags_has_any(spark, sf_dir):
    return bags(spark, sf_dir).where(tg.has_any_key(F.col("tags"), ["k", "name"])).select("event_id")


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def tags_get(spark, sf_dir):
    return bags(spark, sf_dir).select("event_id", tg.get(F.col("tags"), "k").alias("k"))


@query("select distinct unnest(json_keys(props)) as key from events")
def tags_keys_distinct(spark, sf_dir):
    return tg.distinct_keys(bags(spark, sf_dir), "tags")


@query("""with m as (select user_id, event_type, max(coalesce(value, 0)) as v from events group by user_id, event_type)
select user_id, string_agg(event_type || '=' || cast(cast(round(v * 100) as bigint) as varchar), ';' order by event_type) as bag from m group by user_id""")
def tag_map_agg(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.coalesce("value", F.lit(0.0)).alias("v")).withColumn("down", -F.col("v"))
    m = tg.merge_maps(e.withColumn("v", F.round(F.col("v") * 100).cast("bigint").cast("string")), ["user_id"], "event_type", "v", ["down"])
    pairs = F.transform(F.array_sort(F.map_entries("tags")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return m.select("user_id", F.array_join(pairs, ";").alias("bag"))


@query("select p_partkey, case when p_size % 3 = 0 then p_name else p_brand end as label from part")
def name_or_ref(spark, sf_dir):
    bag = F.when(F.col("p_size") % 3 == 0, F.create_map(F.lit("name"), F.col("p_name"), F.lit("ref"), F.col("p_brand"))).otherwise(F.create_map(F.lit("ref"), F.col("p_brand")))
    return table(spark, sf_dir, "part").select("p_partkey", tg.name_or_ref(bag).alias("label"))


@query("select p_partkey, p_name from part where regexp_full_match(p_name, '(red|blue) .*t') order by p_name, p_partkey limit 20")
def similar_to(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").rlike(tx.similar_to("(red|blue) %t"))).select("p_partkey", "p_name").orderBy("p_name", "p_partkey").limit(20)


@query("""select event_id from events where (event_type = 'purchase' and json_extract_string(props, '$.k') = '7') or event_type = 'signup' and value > 50""")
def attr_filter(spark, sf_dir):
    e = bags(spark, sf_dir).withColumn("data", F.map_concat(F.coalesce("tags", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.create_map(F.lit("type"), F.col("event_type"), F.lit("high"), (F.col("value") > 50).cast("string"))))
    return e.where(search.attribute_filter(F.col("data"), [{"type": "purchase", "k": "7"}, {"type": "signup", "high": "true", "a;b": "x"}])).select("event_id")


# ---- changes ----------------------------------------------------------------------------------------------------------


def delta(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select("o_orderkey", "o_custkey", F.lit("X").alias("o_orderstatus"))
    return o.unionByName(o.withColumn("o_orderkey", -F.col("o_orderkey")))


DELTA_SQL = """base as (select o_orderkey, o_custkey, o_orderstatus from orders),
d as (select o_orderkey, o_custkey, 'X' as o_orderstatus from orders where o_orderkey % 10 = 0 union all select -o_orderkey, o_custkey, 'X' from orders where o_orderkey % 10 = 0)"""


def base(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


@query(f"with {DELTA_SQL} select distinct * from d union all select * from base where o_orderkey not in (select o_orderkey from d)")
def upsert_latest(spark, sf_dir):
    return changes.latest_wins(base(spark, sf_dir), delta(spark, sf_dir), ["o_orderkey"])


@query(f"with {DELTA_SQL} select * from base union all select distinct * from d where o_orderkey not in (select o_orderkey from base)")
def insert_first_wins(spark, sf_dir):
    return changes.first_wins(base(spark, sf_dir), delta(spark, sf_dir), ["o_orderkey"], ["o_custkey"])


@query(f"with {DELTA_SQL} select * from base where o_orderkey not in (select o_orderkey from d)")
def tombstone_delete(spark, sf_dir):
    return changes.without(base(spark, sf_dir), delta(spark, sf_dir), ["o_orderkey"])


@query(f"with {DELTA_SQL} select * from base union all select * from d")
def append_only_update(spark, sf_dir):
    return changes.append(base(spark, sf_dir), delta(spark, sf_dir))


@query("select event_id, event_type from events where event_id > 500 and event_id <= (select max(event_id) - 100 from events)")
def delta_since_watermark(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return changes.since(e, "event_id", 500, changes.next_watermark(e, "event_id") - 100).select("event_id", "event_type")


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) as rn from lineitem) where rn = 1")
def distinct_on(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return changes.distinct_on(l, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"])


@query(f"with {DELTA_SQL}, f as (select * from d where o_orderkey % 100 = 0) select distinct * from f union all select * from base where o_orderkey not in (select o_orderkey from f)")
def kept_upsert(spark, sf_dir):
    """A table kept in buckets by key, after a batch of about a hundredth of its rows."""
    kept_table = kept.KeptTable(spark, f"{rounds.shared_folder(spark)}/orders-{uuid.uuid4()}", ["o_orderkey"], 16)
    kept_table.rebuild(base(spark, sf_dir))
    kept_table.merge(delta(spark, sf_dir).where("o_orderkey % 100 = 0").distinct())
    return kept_table.read()


# ---- members, ways, graph ---------------------------------------------------------------------------------------------


@query("select p.p_partkey, t.kind, p.p_name from (select unnest(['part','part','other','part']) as kind, unnest([1, 5, 7, 1000000]) as id) t join part p on p.p_partkey = t.id and t.kind = 'part'")
def zip_ids_join(spark, sf_dir):
    pairs = F.arrays_zip(F.array(*map(F.lit, ("part", "part", "other", "part"))).alias("kind"), F.array(*map(F.lit, (1, 5, 7, 1000000))).alias("id"))
    ids = spark.range(1).select(F.explode(pairs).alias("x")).select(F.col("x.kind").alias("kind"), F.col("x.id").alias("id")).where("kind = 'part'")
    part = table(spark, sf_dir, "part")
    return part.join(F.broadcast(ids), part["p_partkey"] == ids["id"]).select("p_partkey", "kind", "p_name")


def ways(spark, sf_dir):
    """Orders as ways whose nodes are their lines' parts."""
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("nodes"))


@query("""with f as (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as pos, count(*) over (partition by l_orderkey) as n from lineitem)
select l_orderkey as way, cast(pos - 1 as integer) as pos, cast(n as integer) as n, l_partkey as node from f""")
def member_explode(spark, sf_dir):
    return graph.way_nodes(ways(spark, sf_dir)).select("way", "pos", "n", "node")


@query(f"""with {REGISTRY_SQL} select 'R2' as id, 0 as level union all select id, 1 from reg where parent = 'R2' union all select c.id, 2 from reg c join reg n on c.parent = n.id where n.parent = 'R2'""")
def subarea_levels(spark, sf_dir):
    reg = registry(spark, sf_dir)
    edges = reg.where("parent is not null").select("parent", F.col("id").alias("child"))
    return hierarchy.descendants(edges, reg.where("id = 'R2'").select("id"), "parent", "child", 2)


@query("""with m as (select distinct l_orderkey, l_partkey from lineitem)
select distinct x.l_orderkey as a, y.l_orderkey as b from m x join m y on x.l_partkey = y.l_partkey and x.l_orderkey < y.l_orderkey""")
def shared_node_pairs(spark, sf_dir):
    return graph.shared_node_pairs(ways(spark, sf_dir))


@query("""with f as (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) as pos, count(*) over (partition by l_orderkey) as n from lineitem)
select distinct l_partkey as node from f where pos = 1 or pos = n""")
def core_nodes(spark, sf_dir):
    return graph.core_nodes(ways(spark, sf_dir), crossings=False)


def order_points(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag", "l_suppkey"))
    return l.select("l_orderkey", pos.alias("pos"), (F.col("l_returnflag") == "R").alias("cut"), lat_of("l_partkey").alias("lat"), lon_of("l_partkey").alias("lon"))


POINTS_SQL = f"""p as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_returnflag, l_suppkey) as pos, l_returnflag = 'R' as cut, {LAT('l_partkey')} as lat, {LON('l_partkey')} as lon from lineitem)"""


@query(f"""with {POINTS_SQL},
s as (select l_orderkey, pos as to_pos, lag(pos) over w as from_pos, lag(lat) over w as a, lag(lon) over w as b, lat, lon,
        coalesce(sum(cast(cut as integer)) over (partition by l_orderkey order by pos rows between unbounded preceding and 1 preceding), 0) as edge_no from p window w as (partition by l_orderkey order by pos))
select l_orderkey, cast(edge_no as bigint) as edge_no, cast(min(from_pos) as integer) as from_pos, cast(max(to_pos) as integer) as to_pos, count(*) + 1 as n_points, round(sum({HAV('a', 'b', 'lat', 'lon')}), 2) as distance
from s where from_pos is not null group by l_orderkey, edge_no""")
def edge_segmentation(spark, sf_dir):
    out = graph.segments(order_points(spark, sf_dir), "l_orderkey", "pos", "cut", "lat", "lon")
    return out.select("l_orderkey", "edge_no", "from_pos", "to_pos", "n_points", F.round("distance", 2).alias("distance"))


@query("""with e as (select l_orderkey * 10 + l_linenumber as edge, l_orderkey as way, l_partkey as from_node, l_suppkey as to_node from lineitem),
r as (select distinct l_orderkey as from_way, l_orderkey as to_way, l_partkey as via_node from lineitem)
select distinct f.edge as from_edge, t.edge as to_edge, r.via_node from r
join e f on f.way = r.from_way and (f.from_node = r.via_node or f.to_node = r.via_node) join e t on t.way = r.to_way and (t.from_node = r.via_node or t.to_node = r.via_node)""")
def restriction_lift(spark, sf_dir):
    return _lifted(table(spark, sf_dir, "lineitem"))


def _lifted(l):
    edges = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge"), F.col("l_orderkey").alias("way"), F.col("l_partkey").alias("from_node"), F.col("l_suppkey").alias("to_node"))
    rest = l.select(F.col("l_orderkey").alias("from_way"), F.col("l_orderkey").alias("to_way"), F.col("l_partkey").alias("via_node")).distinct()
    return graph.lift(rest, edges)


@query("select l_orderkey, l_partkey, l_suppkey from lineitem l where not exists (select 1 from lineitem r where r.l_returnflag = 'R' and r.l_orderkey = l.l_orderkey and r.l_partkey = l.l_partkey and r.l_suppkey = l.l_suppkey)")
def anti_restriction(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return changes.without(l, l.where("l_returnflag = 'R'"), ["l_orderkey", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey", "l_suppkey")


@query(f"""with {POINTS_SQL}, q as (select l_orderkey, pos, lag(lat) over w as y1, lag(lon) over w as x1, lat as y2, lon as x2, lead(lat) over w as y3, lead(lon) over w as x3 from p window w as (partition by l_orderkey order by pos)),
a as (select l_orderkey, pos, (x1-x2)*(x3-x2)+(y1-y2)*(y3-y2) as dot, sqrt((x1-x2)*(x1-x2)+(y1-y2)*(y1-y2)) * sqrt((x3-x2)*(x3-x2)+(y3-y2)*(y3-y2)) as size from q where y1 is not null and y3 is not null),
g as (select l_orderkey, cast(pos as integer) as pos, case when size = 0 then 180.0 else degrees(acos(greatest(-1.0, least(1.0, dot / size)))) end as angle from a)
select l_orderkey, pos, round(angle, 3) as angle from g where angle < 60""")
def sharp_angle(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("pos")
    p = order_points(spark, sf_dir).select("l_orderkey", "pos", "lat", "lon", *[f(c).over(w).alias(n) for f, c, n in ((F.lag, "lat", "y1"), (F.lag, "lon", "x1"), (F.lead, "lat", "y3"), (F.lead, "lon", "x3"))])
    p = p.where("y1 is not null and y3 is not null").withColumn("angle", geo.angle(F.col("y1"), F.col("x1"), F.col("lat"), F.col("lon"), F.col("y3"), F.col("x3")))
    return p.where("angle < 60").select("l_orderkey", "pos", F.round("angle", 3).alias("angle"))


def road_ways(spark, sf_dir):
    """(id, nodes, tags): orders as roads over their parts; (id, lat, lon) of the parts, every 37th of which is unknown."""
    k = F.col("id")
    tags = F.create_map(F.lit("highway"), F.element_at(F.array(*map(F.lit, _HW)), (k % 5).cast("int") + 1), F.lit("oneway"), F.when(k % 3 == 0, "yes").otherwise("no"))
    nodes = table(spark, sf_dir, "part").where("p_partkey % 37 <> 0").select(F.col("p_partkey").alias("id"), lat_of("p_partkey").alias("lat"), lon_of("p_partkey").alias("lon"))
    return ways(spark, sf_dir).withColumn("tags", tags), nodes


WAY_SQL = f"""f as (select l_orderkey as way, l_partkey as node, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 as pos, count(*) over (partition by l_orderkey) as n from lineitem),
nd as (select p_partkey as node, {LAT('p_partkey')} as lat, {LON('p_partkey')} as lon from part where p_partkey % 37 <> 0)"""


@query(f"""with {WAY_SQL}, e as (select a.way, a.node, b.node as next from f a join f b on a.way = b.way where a.n > 1 and (a.pos = 0 and b.pos = 1 or a.pos = a.n - 1 and b.pos = a.n - 2)),
x as (select e.way, e.node, p.lat as y2, p.lon as x2, q.lat as y1, q.lon as x1 from e join nd p on p.node = e.node join nd q on q.node = e.next),
m as (select a.way as from_way, b.way as to_way, a.node as via_node, (a.x1 - a.x2) * (b.x1 - b.x2) + (a.y1 - a.y2) * (b.y1 - b.y2) as dot, sqrt((a.x1 - a.x2) * (a.x1 - a.x2) + (a.y1 - a.y2) * (a.y1 - a.y2)) * sqrt((b.x1 - b.x2) * (b.x1 - b.x2) + (b.y1 - b.y2) * (b.y1 - b.y2)) as size
  from x a join x b on a.node = b.node and a.way <> b.way)
select distinct from_way, to_way, via_node from m where size > 0 and degrees(acos(greatest(-1.0, least(1.0, dot / size)))) < 60 - 1e-9""")
def sharp_turn_bars(spark, sf_dir):
    w, nodes = road_ways(spark, sf_dir)
    return graph.sharp_restrictions(w, nodes, degrees=60 - 1e-9).select("from_way", "to_way", "via_node")


@query(f"""with {WAY_SQL}, u as (select * from f where way % 5 <> 4), c as (select node from u group by node having count(*) > 1 or bool_or(pos = 0 or pos = n - 1)),
r as (select u.*, nd.lat, nd.lon, c.node is not null as core, max(case when nd.node is null then 1 else 0 end) over (partition by way order by pos) as broken from u left join nd using (node) left join c using (node)),
s as (select *, lag(lat) over w as py, lag(lon) over w as px, lag(node) over w as before, sum(core::int) over (partition by way order by pos rows between unbounded preceding and 1 preceding) as seg from r where broken = 0 window w as (partition by way order by pos)),
g as (select way, seg, sum({HAV('py', 'px', 'lat', 'lon')}) as distance, first(before order by pos) as from_node, last(node order by pos) as to_node, last(core order by pos) as whole from s where before is not null group by way, seg),
b as (select way, from_node, to_node, min(distance) as distance from g where whole group by way, from_node, to_node)
select way, from_node, to_node, round(distance, 2) as distance, round(distance * 3.6 / case way % 5 when 0 then 120.0 when 1 then 90.0 when 2 then 50.0 else 30.0 end, 3) as car,
  round(case way % 5 when 0 then null else distance * 3.6 / 15 end, 3) as bicycle, cast(case when way % 3 = 0 then 1 else 0 end + case when way % 5 = 0 then 3 else 0 end as integer) as direction from b""")
def search_edges(spark, sf_dir):
    w, nodes = road_ways(spark, sf_dir)
    e = graph.search_edges(w, nodes, {n: vehicle.PROFILES[n] for n in ("car", "bicycle")})
    at = lambda m, k: F.try_element_at(m, F.lit(k))
    return e.select("way", "from_node", "to_node", F.round("distance", 2).alias("distance"), F.round(at("weight", "car"), 3).alias("car"), F.round(at("weight", "bicycle"), 3).alias("bicycle"), at("direction", "car").alias("direction"))


@query("""select 'motorcar' as vehicle, 'no_left_turn' as kind, o_orderkey as from_way, o_custkey as to_way, o_orderkey % 1000 as via_node from orders where o_orderkey % 4 = 1
union all select 'bus', 'only_straight_on', o_orderkey, o_custkey, o_orderkey % 1000 from orders where o_orderkey % 4 in (1, 2)""")
def relation_bars(spark, sf_dir):
    k = F.col("o_orderkey")
    member = lambda i, role, kind: F.struct(i.alias("id"), F.lit(role).alias("role"), F.lit(kind).alias("type"))
    tags = F.map_filter(F.create_map(F.lit("restriction"), F.when(k % 4 == 1, "no_left_turn").otherwise("none"), F.lit("restriction:bus"), F.when((k % 4).isin(1, 2), "only_straight_on"), F.lit("type"), F.lit("restriction")), lambda _, v: v.isNotNull())
    rel = table(spark, sf_dir, "orders").select(k.alias("id"), tags.alias("tags"), F.array(member(k, "from", 1), member(F.col("o_custkey"), "to", 1), member(k % 1000, "via", 0), member(k % 500, "via", 1)).alias("members"))
    return graph.relation_restrictions(rel)


def nation_edges(spark, sf_dir):
    """Each nation leads to three others by its number."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("a"))
    e = n.select("a", F.explode(F.array(F.lit(1), F.lit(5), F.lit(7))).alias("s"))
    return e.select((F.col("a") * 10 + F.col("s")).alias("edge"), "a", ((F.col("a") * 3 + F.col("s")) % 25).alias("b"), ((F.col("a") * F.col("s")) % 11 + 1).cast("double").alias("w"))


EDGES_SQL = "e as (select a * 10 + s as edge, a, (a * 3 + s) % 25 as b, cast((a * s) % 11 + 1 as double) as w from (select cast(n_nationkey as bigint) as a from nation), (select unnest([1, 5, 7]) as s))"


@query(f"with {EDGES_SQL} select source, node, min(cost) as cost from (select 0 as source, 0 as node, 0.0 as cost union all select 0, b, w from e where a = 0) group by source, node")
def frontier_relax(spark, sf_dir):
    start = spark.range(1).select(F.lit(0).cast("bigint").alias("source"), F.lit(0).cast("bigint").alias("node"), F.lit(0.0).alias("cost"), F.lit(None).cast("bigint").alias("via"))
    return routing.relax(start, nation_edges(spark, sf_dir)).select("source", "node", "cost")


@query(f"""with recursive {EDGES_SQL}, k as (select cast(n_nationkey as bigint) as source, cast(n_nationkey as bigint) as node, 0.0::double as cost, 0 as hops from nation where n_nationkey < 5
  union all select source, b, cost + w, hops + 1 from k join e on k.node = e.a where hops < 4)
select source, node, min(cost) as cost from k group by source, node""")
def k_hop_cost(spark, sf_dir):
    sources = table(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").cast("bigint").alias("source"))
    return routing.k_hop_costs(nation_edges(spark, sf_dir), sources, 4).select("source", "node", "cost")


@query(f"""with recursive {EDGES_SQL}, k as (select cast(n_nationkey as bigint) as source, cast(n_nationkey as bigint) as node, 0.0::double as cost, 0 as hops from nation where n_nationkey < 4
  union select source, b, cost + w, hops + 1 from k join e on k.node = e.a where hops < 8)
select source * 100 + node as query, min(cost) as cost from k where node in (6, 13, 20) group by source, node""")
def shortest_path_mm(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("node"), (F.col("n_nationkey") % 5).cast("double").alias("lat"), (F.col("n_nationkey") % 7).cast("double").alias("lon"))
    q = n.where("node < 4").select(F.col("node").alias("source"), F.explode(F.array(*[F.lit(x).cast("bigint") for x in (6, 13, 20)])).alias("target")).withColumn("query", F.col("source") * 100 + F.col("target"))
    return routing.shortest_paths(q, nation_edges(spark, sf_dir), n, method="mm").where("cost is not null").select("query", "cost")


@query(f"""with {EDGES_SQL}, f as (select b, min(w) as g from e where a = 0 group by b), r as (select a, min(w) as g from e where b = 3 group by a)
select f.b as x, r.a as y, f.g + r.g + abs(f.b - r.a) as bound from f, r""")
def frontier_pairs(spark, sf_dir):
    e = nation_edges(spark, sf_dir).withColumn("query", F.lit(1))
    f = e.where("a = 0").groupBy("query", F.col("b").alias("x")).agg(F.min("w").alias("gx"))
    r = e.where("b = 3").groupBy("query", F.col("a").alias("y")).agg(F.min("w").alias("gy"))
    return routing.frontier_pairs(f, r, F.abs(F.col("x") - F.col("y"))).select("x", "y", "bound")


def customer_graph(spark, sf_dir):
    """(edge, a, b, w): each customer leads to three others by its number; turns (from_edge, to_edge, via_node) at a fifth of the meetings are barred."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"))
    n = F.broadcast(c.agg(F.count(F.lit(1)).alias("n")))
    e = c.select("a", F.explode(F.array(F.lit(1), F.lit(5), F.lit(7))).alias("s")).join(n)
    e = e.select((F.col("a") * 10 + F.col("s")).alias("edge"), "a", ((F.col("a") * 3 + F.col("s")) % F.col("n") + 1).alias("b"), (1 + (F.col("a") * 7919 + F.col("s") * 104729) % 999983 / F.lit(1000003.0)).alias("w"))
    turns = e.alias("x").join(e.alias("y"), F.col("x.b") == F.col("y.a")).where((F.col("x.edge") * 31 + F.col("y.edge")) % 5 == 0)
    return e, turns.select(F.col("x.edge").alias("from_edge"), F.col("y.edge").alias("to_edge"), F.col("y.a").alias("via_node"))


@query("""with recursive n as (select count(*) as n from customer),
e as (select c_custkey * 10 + s as edge, c_custkey as a, (c_custkey * 3 + s) % n + 1 as b, 1 + (c_custkey * 7919 + s * 104729) % 999983 / 1000003.0::double as w from customer, n, (select unnest([1, 5, 7]) as s)),
t as (select x.edge as from_edge, y.edge as to_edge from e x join e y on x.b = y.a where (x.edge * 31 + y.edge) % 5 = 0),
q as (select n_nationkey as query, n_nationkey * 37 % n + 1 as source, n_nationkey * 101 % n + 1 as target from nation, n),
lab(query, edge, node, g, path) using key (query, edge) as (
  select query, edge, b, w, [edge] from q join e on a = source
  union (select l.query, e.edge, e.b, l.g + e.w, list_append(l.path, e.edge) from lab l join e on e.a = l.node left join recurring.lab o on o.query = l.query and o.edge = e.edge
    where not exists (select 1 from t where t.from_edge = l.edge and t.to_edge = e.edge) and (o.g is null or l.g + e.w < o.g - 1e-12)
    qualify row_number() over (partition by l.query, e.edge order by l.g + e.w) = 1)),
r as (select q.query, source, target, first(struct_pack(g := g, path := path) order by g) as r from q left join lab on lab.query = q.query and lab.node = q.target group by q.query, source, target)
select query, case when source = target then 0.0 else round(r.g, 6) end as cost, case when source = target then '' else array_to_string(coalesce(r.path, []), ',') end as path from r""")
def turn_routes(spark, sf_dir):
    e, turns = customer_graph(spark, sf_dir)
    n = F.broadcast(table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n")))
    q = table(spark, sf_dir, "nation").join(n).select(F.col("n_nationkey").cast("bigint").alias("query"), (F.col("n_nationkey") * 37 % F.col("n") + 1).alias("source"), (F.col("n_nationkey") * 101 % F.col("n") + 1).alias("target"))
    nodes = e.select(F.col("a").alias("node"), lat_of("a").alias("lat"), lon_of("a").alias("lon")).distinct()
    found = routing.shortest_paths(q, e, nodes, turns)
    return found.select("query", F.round("cost", 6).alias("cost"), F.array_join("path", ",").alias("path"))


# ---- vehicles ---------------------------------------------------------------------------------------------------------

_HW_SQL = "['motorway', 'primary', 'residential', 'service', 'footway'][1 + cast(p_partkey % 5 as integer)]"
_MS_SQL = "case when p_size % 3 = 0 then cast(p_size as varchar) when p_size % 3 = 1 then p_size || ' mph' end"


def road_bags(spark, sf_dir):
    """Parts as roads: a class, a posted speed, access and one-way tags."""
    k, s = F.col("p_partkey"), F.col("p_size")
    pairs = [
        (F.lit("highway"), F.element_at(F.array(*map(F.lit, _HW)), (k % 5).cast("int") + 1)), (F.lit("maxspeed"), F.when(s % 3 == 0, s.cast("string")).when(s % 3 == 1, F.concat(s.cast("string"), F.lit(" mph")))),
        (F.lit("access"), F.when(k % 11 == 0, "no").when(k % 13 == 0, "private")), (F.lit("motorcar"), F.when(k % 13 == 0, "yes")), (F.lit("oneway"), F.when(k % 4 == 0, "yes").when(k % 4 == 1, "-1").when(k % 4 == 2, "no")),
    ]
    return table(spark, sf_dir, "part").withColumn("tags", F.map_filter(F.create_map(*[x for kv in pairs for x in kv]), lambda _, v: v.isNotNull()))


@query(f"""with t as (select p_partkey, {_HW_SQL} as hw, {_MS_SQL} as ms, case when p_partkey % 11 = 0 then 'no' when p_partkey % 13 = 0 then 'private' end as acc, case when p_partkey % 13 = 0 then 'yes' end as car,
  case p_partkey % 4 when 0 then 'yes' when 1 then '-1' when 2 then 'no' end as oneway from part),
b as (select *, case hw when 'motorway' then 120.0 when 'primary' then 90.0 when 'residential' then 50.0 when 'service' then 30.0 end as base, case when car = 'yes' then true when acc in ('no', 'private') then false else true end as ok from t),
s as (select *, case when base is not null and ok then coalesce(0.75 * try_cast(ms as double), base) end as speed from b)
select p_partkey, round(3.6 / speed, 6) as factor, round(3.6 / speed / case hw when 'motorway' then 10.0 when 'primary' then 8.0 when 'residential' then 5.0 else 4.0 end, 6) as class_factor,
  cast(case oneway when 'yes' then 1 when '-1' then 2 else 0 end + case when hw = 'motorway' then 3 else 0 end as integer) as direction from s""")
def vehicle_factor(spark, sf_dir):
    p = road_bags(spark, sf_dir)
    car, bag = vehicle.PROFILES["car"], F.col("tags")
    f = vehicle.factors(bag, car)
    return p.select("p_partkey", F.round(f["fastest"], 6).alias("factor"), F.round(f["classifications"], 6).alias("class_factor"), vehicle.direction(bag, car).cast("int").alias("direction"))


@query(f"""with t as (select p_partkey, {_HW_SQL} as hw, case when p_size % 3 = 0 then p_size * 1.0 when p_size % 3 = 1 then p_size * 1.60934 end as kmh,
  case when p_partkey % 13 = 0 then true when p_partkey % 11 = 0 then false else true end as motor, case when p_partkey % 11 = 0 or p_partkey % 13 = 0 then false else true end as other from part),
b as (select *, case hw when 'motorway' then 120.0 when 'primary' then 90.0 when 'residential' then 50.0 when 'service' then 30.0 end as car, case hw when 'primary' then 40.0 when 'residential' then 40.0 when 'service' then 30.0 end as moped from t)
select p_partkey, round(case when motor and car is not null then coalesce(0.75 * kmh, 0.75 * car) end, 6) as car_script, round(case when motor and car is not null then coalesce(0.75 * kmh, car) end, 6) as bus,
  round(case when other and moped is not null then coalesce(0.75 * least(kmh, 40), moped) end, 6) as moped, case when other and hw not in ('motorway', 'footway') then 15.0 end as bicycle, case when other and hw <> 'motorway' then 4.0 end as pedestrian from b""")
def vehicle_speeds(spark, sf_dir):
    of = lambda name: F.round(vehicle.speed(F.col("tags"), vehicle.PROFILES[name]), 6).alias(name)
    return road_bags(spark, sf_dir).select("p_partkey", *map(of, ("car_script", "bus", "moped", "bicycle", "pedestrian")))


@query("""select p_partkey, round(cast(p_size as double) * 1.60934, 6) as kmh, round(cast(p_size as double) * 1000, 6) as kg, round(cast(p_size as double) * 0.3048 + 3 * 0.0254, 6) as m, round(cast(p_size as double) * 1.852, 6) as knots from part""")
def unit_parse(spark, sf_dir):
    size = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(units.speed_kmh(F.concat(size, F.lit(" mph"))), 6).alias("kmh"), F.round(units.weight_kg(F.concat(size, F.lit(" t"))), 6).alias("kg"),
        F.round(units.length_m(F.concat(size, F.lit("'3\""))), 6).alias("m"), F.round(units.speed_kmh(F.concat(size, F.lit(" knots"))), 6).alias("knots"),
    )


# ---- space ------------------------------------------------------------------------------------------------------------


def customer_points(spark, sf_dir):
    return table(spark, sf_dir, "customer").withColumns({"lat": lat_of("c_custkey"), "lon": lon_of("c_custkey")})


CP_SQL = f"cp as (select *, {LAT('c_custkey')} as lat, {LON('c_custkey')} as lon from customer)"


@query(f"with {CP_SQL} select c_custkey, round({HAV('lat', 'lon', '48.85', '2.35')}, 3) as distance from cp order by {HAV('lat', 'lon', '48.85', '2.35')}, c_custkey limit 25")
def haversine_topk(spark, sf_dir):
    return spatial.nearest(customer_points(spark, sf_dir), "lat", "lon", 48.85, 2.35, 25, "c_custkey").select("c_custkey", F.round("distance", 3).alias("distance"))


@query(f"with {CP_SQL} select c_custkey, round(sqrt((lat - 48.85) * (lat - 48.85) + (lon - 2.35) * (lon - 2.35)), 6) as distance from cp order by (lat - 48.85) * (lat - 48.85) + (lon - 2.35) * (lon - 2.35), c_custkey limit 25")
def planar_knn(spark, sf_dir):
    return spatial.nearest(customer_points(spark, sf_dir), "lat", "lon", 48.85, 2.35, 25, "c_custkey", planar=True).select("c_custkey", F.round("distance", 6).alias("distance"))


@query(f"""with s as (select s_suppkey, {LAT('s_suppkey')} as y1, {LON('s_suppkey')} as x1, lead({LAT('s_suppkey')}) over w as y2, lead({LON('s_suppkey')}) over w as x2 from supplier window w as (partition by s_nationkey order by s_suppkey)),
t as (select *, greatest(0.0, least(1.0, coalesce(((10.0 - x1) * (x2 - x1) + (20.0 - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0.0))) as t from s where y2 is not null),
d as (select s_suppkey, t, sqrt(pow(y1 + t * (y2 - y1) - 20.0, 2) + pow(x1 + t * (x2 - x1) - 10.0, 2)) as d from t)
select s_suppkey, round(t, 6) as t, round(d, 6) as distance from d order by d, s_suppkey limit 3""")
def snap_to_segment(spark, sf_dir):
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", lat_of("s_suppkey").alias("y1"), lon_of("s_suppkey").alias("x1"))
    s = s.withColumns({"y2": F.lead("y1").over(w), "x2": F.lead("x1").over(w)}).where("y2 is not null")
    p = geo.closest_on_segment(F.lit(20.0), F.lit(10.0), F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"))
    d = s.withColumn("p", p).withColumn("d", F.sqrt(geo.planar2(F.col("p.lat"), F.col("p.lon"), F.lit(20.0), F.lit(10.0))))
    return d.orderBy("d", "s_suppkey").limit(3).select("s_suppkey", F.round("p.t", 6).alias("t"), F.round("d", 6).alias("distance"))


SUPPLIER_LINES_SQL = f"""sl as (select s_suppkey as edge, s_suppkey % 6 as direction, {LAT('s_suppkey * 13')} as y1, {LON('s_suppkey * 29')} as x1, {LAT('s_suppkey * 13')} + s_suppkey % 7 - 3 as y2, {LON('s_suppkey * 29')} + s_suppkey % 11 - 5 as x2,
  {LAT('s_suppkey * 13')} + s_suppkey % 5 - 6 as y3, {LON('s_suppkey * 29')} + s_suppkey % 3 + 2 as x3 from supplier where s_suppkey % 10 <> 0)"""


def supplier_lines(spark, sf_dir):
    """(edge, shape, direction, weight): a line of three points for each supplier; every tenth has no weight."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").withColumns({"k1": k * 13, "k2": k * 29})
    p = lambda dy, dx: F.struct((lat_of("k1") + dy).alias("lat"), (lon_of("k2") + dx).alias("lon"))
    zero = F.lit(0)
    return s.select(k.alias("edge"), F.array(p(zero, zero), p(k % 7 - 3, k % 11 - 5), p(k % 5 - 6, k % 3 + 2)).alias("shape"), (k % 6).alias("direction"), F.when(k % 10 != 0, 1.0).alias("weight"))


@query(f"""with {CP_SQL}, {SUPPLIER_LINES_SQL},
g as (select edge, 1 as i, y1, x1, y2, x2 from sl where direction in (0, 1, 2) union all select edge, 2, y2, x2, y3, x3 from sl where direction in (0, 1, 2)),
t as (select c_custkey, lat, lon, edge, i, y1, x1, y2, x2, greatest(0.0, least(1.0, coalesce(((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0), 0.0))) as t from cp, g),
d as (select c_custkey, edge, i, y1 + t * (y2 - y1) as py, x1 + t * (x2 - x1) as px, round(sqrt(pow(y1 + t * (y2 - y1) - lat, 2) + pow(x1 + t * (x2 - x1) - lon, 2)), 9) as d from t),
n as (select * from d qualify row_number() over (partition by c_custkey order by d, edge, i) = 1),
o as (select n.*, h.i as part, abs({HAV('py', 'px', 'h.y1', 'h.x1')} + {HAV('py', 'px', 'h.y2', 'h.x2')} - {HAV('h.y1', 'h.x1', 'h.y2', 'h.x2')}) < 1 as on_it from n join g h on h.edge = n.edge)
select c_custkey, edge, round(any_value(d), 6) as distance, round(any_value(py), 6) as lat, round(any_value(px), 6) as lon, cast(coalesce(min(part) filter (where on_it), 0) as integer) as "offset" from o group by c_custkey, edge""")
def snap_join(spark, sf_dir):
    points = customer_points(spark, sf_dir).select(F.col("c_custkey").alias("id"), "lat", "lon")
    put = snapping.snap(points, supplier_lines(spark, sf_dir), 2.0)
    return put.select(F.col("id").alias("c_custkey"), "edge", F.round("distance", 6).alias("distance"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "offset")


@query(f"with {CP_SQL} select c_custkey from cp where lat between -70 and -40 and lon between -160 and -60")
def bbox_window(spark, sf_dir):
    return customer_points(spark, sf_dir).where(geo.in_box(F.col("lat"), F.col("lon"), -70, -160, -40, -60)).select("c_custkey")


AREA_SQL = f"""area as (select n_nationkey, {LAT('n_nationkey * 311')} as south, {LON('n_nationkey * 97')} as west, {LAT('n_nationkey * 311')} + 12 as north, {LON('n_nationkey * 97')} + 25 as east from nation)"""


def areas(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 311).alias("k1"), (F.col("n_nationkey") * 97).alias("k2"))
    return n.select("n_nationkey", lat_of("k1").alias("south"), lon_of("k2").alias("west"), (lat_of("k1") + 12).alias("north"), (lon_of("k2") + 25).alias("east"))


@query(f"with {CP_SQL}, {AREA_SQL} select c_custkey, n_nationkey from cp join area on lat between south and north and lon between west and east")
def grid_within(spark, sf_dir):
    return spatial.within_boxes(customer_points(spark, sf_dir), areas(spark, sf_dir), "lat", "lon", 5.0).select("c_custkey", "n_nationkey")


@query(f"with {AREA_SQL} select a.n_nationkey as a, b.n_nationkey as b from area a join area b on a.n_nationkey < b.n_nationkey and a.south - 12 <= b.north and b.south <= a.north + 12 and a.west - 12 <= b.east and b.west <= a.east + 12")
def box_ops(spark, sf_dir):
    a = areas(spark, sf_dir).select(F.col("n_nationkey").alias("a"), F.struct("south", "west", "north", "east").alias("x")).withColumn("x", geo.resize_box(F.col("x"), 12.0))
    b = areas(spark, sf_dir).select(F.col("n_nationkey").alias("b"), F.struct("south", "west", "north", "east").alias("y"))
    cut = lambda d, c, k: d.select(k, c, F.explode(spatial.cells_of_box(F.col(c)["south"], F.col(c)["west"], F.col(c)["north"], F.col(c)["east"], 10.0)).alias("cell"))
    met = cut(a, "x", "a").join(cut(b, "y", "b"), "cell").where(F.col("a") < F.col("b"))
    return met.where(geo.boxes_overlap(F.col("x"), F.col("y"))).select("a", "b").distinct()


#: An L with a hole, in degrees from a corner.
L_RINGS = [[(0, 0), (0, 40), (14, 40), (14, 18), (30, 18), (30, 0)], [(4, 4), (4, 12), (10, 12), (10, 4)]]


def l_areas(spark, sf_dir):
    """(area, rings): an L with a hole for each nation."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("area"), (F.col("n_nationkey") * 311).alias("k1"), (F.col("n_nationkey") * 97).alias("k2"))
    return n.select("area", F.array(*[F.array(*[F.struct((lat_of("k1") + y + 0.005).alias("lat"), (lon_of("k2") + x + 0.005).alias("lon")) for y, x in r]) for r in L_RINGS]).alias("rings"))


L_SQL = "l as (select * from (values " + ", ".join(f"({r}, {i}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for r, ring in enumerate(L_RINGS) for i, (a, b) in enumerate(zip(ring, ring[1:] + ring[:1]))) + f""") as v(ring, seg, a, b, c, d)),
ar as (select n_nationkey as area, ring, seg, {LAT('n_nationkey * 311')} + a + 0.005 as y1, {LON('n_nationkey * 97')} + b + 0.005 as x1, {LAT('n_nationkey * 311')} + c + 0.005 as y2, {LON('n_nationkey * 97')} + d + 0.005 as x2 from nation, l)"""


@query(f"""with {CP_SQL}, {L_SQL} select c_custkey, area from cp join ar on (y1 > lat) <> (y2 > lat) and lon < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1 group by c_custkey, area having count(*) % 2 = 1""")
def points_in_areas(spark, sf_dir):
    grid = containment.AreaCells(l_areas(spark, sf_dir), 3.0)
    return grid.holding(customer_points(spark, sf_dir).select("c_custkey", "lat", "lon")).select("c_custkey", "area")


def customer_shapes(spark, sf_dir):
    """(id, kind, rings): a point, a line or a polygon at each customer's place."""
    c = customer_points(spark, sf_dir)
    p = lambda y, x: F.struct((F.col("lat") + y).alias("lat"), (F.col("lon") + x).alias("lon"))
    line, shape = F.array(p(0, 0), p(7, 1), p(1, 9)), F.array(p(0, 0), p(8, 2), p(3, 11))
    kind = F.element_at(F.array(*map(F.lit, ("point", "line", "polygon"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    return c.select(F.col("c_custkey").alias("id"), kind.alias("kind"), F.array(F.when(kind == "point", F.array(p(0, 0))).when(kind == "line", line).otherwise(shape)).alias("rings"))


@query(f"""with {CP_SQL}, {L_SQL}, h as (select c_custkey, area from cp join ar on (y1 > lat) <> (y2 > lat) and lon < (lat - y1) * ((x2 - x1) / (y2 - y1)) + x1 group by c_custkey, area having count(*) % 2 = 1),
d as (select h.c_custkey, case n_nationkey % 4 when 0 then 'addr:city' when 1 then 'addr:region' when 2 then 'addr:building' else 'addr:railway:station' end as key, n_name as value from h join nation on area = n_nationkey
  union all select h.c_custkey, 'addr:postcode', cast(100000 + n_nationkey as varchar) from h join nation on area = n_nationkey where n_nationkey % 4 = 3)
select c_custkey, key, min(value) as value from d where not (key = 'addr:city' and c_custkey % 5 = 0) group by c_custkey, key union all select c_custkey, 'addr:city', 'own' from cp where c_custkey % 5 = 0""")
def enriched_places(spark, sf_dir):
    bag = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    points = customer_points(spark, sf_dir).select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 == 0, bag("addr:city", "own")).otherwise(F.create_map().cast("map<string,string>")).alias("tags"), F.lit("point").alias("kind"), F.array(F.array(F.struct("lat", "lon"))).alias("rings"))
    n, name = F.col("n_nationkey"), F.col("n_name")
    kinds = F.when(n % 4 == 0, bag("place", "city", "name", name)).when(n % 4 == 1, bag("type", "boundary", "admin_level", "4", "name", name)).when(n % 4 == 2, bag("building", "yes", "ref", name)).otherwise(bag("railway", "station", "name", name, "addr:postcode", (n + 100000).cast("string")))
    areas_ = l_areas(spark, sf_dir).join(table(spark, sf_dir, "nation"), F.col("area") == n).select((-n.cast("bigint") - 1).alias("id"), kinds.alias("tags"), F.lit("polygon").alias("kind"), "rings")
    out = places.enrich(points.unionByName(areas_), cell=3.0)
    return out.where("id >= 0").select(F.col("id").alias("c_custkey"), F.explode("tags").alias("key", "value"))


_SIDE = "sign(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"
_APART = " and ".join(
    f"{_SIDE.format(ay=a[0], ax=a[1], by=a[2], bx=a[3], py=b[0], px=b[1])} * {_SIDE.format(ay=a[0], ax=a[1], by=a[2], bx=a[3], py=b[2], px=b[3])} < 0"
    for a, b in ((("s.y1", "s.x1", "s.y2", "s.x2"), ("e.y1", "e.x1", "e.y2", "e.x2")), (("e.y1", "e.x1", "e.y2", "e.x2"), ("s.y1", "s.x1", "s.y2", "s.x2")))
)
_RAY = "({e}.y1 > {p}.lat) <> ({e}.y2 > {p}.lat) and {p}.lon < ({p}.lat - {e}.y1) * (({e}.x2 - {e}.x1) / ({e}.y2 - {e}.y1)) + {e}.x1"


@query(f"""with {CP_SQL}, {L_SQL},
v as (select c_custkey as id, c_custkey % 3 as k, i, lat + case i when 1 then case when c_custkey % 3 = 1 then 7 else 8 end when 2 then case when c_custkey % 3 = 1 then 1 else 3 end else 0 end as lat,
  lon + case i when 1 then case when c_custkey % 3 = 1 then 1 else 2 end when 2 then case when c_custkey % 3 = 1 then 9 else 11 end else 0 end as lon from cp, (select unnest([0, 1, 2]) as i) where c_custkey % 3 <> 0 or i = 0),
h as (select v.id, v.i, e.area from v join ar e on {_RAY.format(e='e', p='v')} group by v.id, v.i, e.area having count(*) % 2 = 1),
w as (select id, area from h group by id, area having count(*) = case when id % 3 = 0 then 1 else 3 end),
s as (select a.id, a.k, a.i, a.lat as y1, a.lon as x1, b.lat as y2, b.lon as x2 from v a join v b on a.id = b.id and b.i = (a.i + 1) % 3 where a.k = 2 or a.k = 1 and a.i < 2),
c as (select distinct w.id, w.area from w join s on s.id = w.id join ar e on e.area = w.area where {_APART}),
o as (select w.id, w.area from w join ar p on p.area = w.area and p.seg = 0 join s e on e.id = w.id and e.k = 2 where {_RAY.replace('{p}.lat', '{p}.y1').replace('{p}.lon', '{p}.x1').format(e='e', p='p')} group by w.id, w.area, p.ring having count(*) % 2 = 1)
select id, area from w where not exists (select 1 from c where c.id = w.id and c.area = w.area) and not exists (select 1 from o where o.id = w.id and o.area = w.area)""")
def places_within(spark, sf_dir):
    return containment.within(customer_shapes(spark, sf_dir), l_areas(spark, sf_dir), 3.0)


PENTAGON = [(-20.0, -60.0), (35.0, -40.0), (50.0, 20.0), (10.0, 70.0), (-30.0, 15.0)]
_CROSS = " + ".join(
    f"case when ({y1} > lat) <> ({y2} > lat) and lon < (lat - ({y1})) * (({x2} - ({x1})) / ({y2} - ({y1}))) + ({x1}) then 1 else 0 end" for (y1, x1), (y2, x2) in zip(PENTAGON, PENTAGON[1:] + PENTAGON[:1])
)


@query(f"with {CP_SQL} select c_custkey from cp where ({_CROSS}) % 2 = 1")
def point_in_polygon(spark, sf_dir):
    return customer_points(spark, sf_dir).where(geo.in_ring(F.col("lat"), F.col("lon"), PENTAGON)).select("c_custkey")


@query(f"""with {CP_SQL}, {SUPPLIER_LINES_SQL}, v as (select c_custkey as id, lat as y1, lon as x1, lat + 7 as y2, lon + 1 as x2, lat + 1 as y3, lon + 9 as x3 from cp where c_custkey % 3 = 1),
a as (select id, 0 as seg, y1, x1, y2, x2 from v union all select id, 1, y2, x2, y3, x3 from v), b as (select edge as id, 0 as seg, y1, x1, y2, x2 from sl union all select edge, 1, y2, x2, y3, x3 from sl),
t as (select a.id as a, b.id as b, a.seg as a_seg, b.seg as b_seg, a.y1, a.x1, a.y2, a.x2, ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / nullif((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1), 0) as t,
  ((b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1)) / nullif((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1), 0) as u from a, b)
select a, b, a_seg, b_seg, round(y1 + t * (y2 - y1), 6) as lat, round(x1 + t * (x2 - x1), 6) as lon from t where t between 0 and 1 and u between 0 and 1""")
def line_crossings(spark, sf_dir):
    a = customer_shapes(spark, sf_dir).where("kind = 'line'").select("id", F.col("rings")[0].alias("shape"), F.lit(False).alias("closed"))
    b = supplier_lines(spark, sf_dir).where("weight is not null").select(F.col("edge").alias("id"), "shape", F.lit(False).alias("closed"))
    return crossings.crossings(a, b, 3.0).select("a", "b", "a_seg", "b_seg", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"""with {SUPPLIER_LINES_SQL}, d as (select *, {HAV('y1', 'x1', 'y2', 'x2')} as d1, {HAV('y2', 'x2', 'y3', 'x3')} as d2, edge % 9 * 100000.0::double as m from sl),
t as (select *, case when m > d1 then least(1.0, (m - d1) / d2) end as t2, case when d1 > 0 then least(1.0, m / d1) else 0 end as t1 from d)
select edge, round(coalesce(y2 + t2 * (y3 - y2), y1 + t1 * (y2 - y1)), 6) as lat, round(coalesce(x2 + t2 * (x3 - x2), x1 + t1 * (x2 - x1)), 6) as lon from t""")
def along_lines(spark, sf_dir):
    s = supplier_lines(spark, sf_dir).where("weight is not null").withColumn("p", geo.along_line(F.col("shape"), (F.col("edge") % 9 * 100000).cast("double")))
    return s.select("edge", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))


_INTER = lambda a, b: "greatest(0, least({0}3, {1}3) - greatest({0}1, {1}1)) * greatest(0, least({0}4, {1}4) - greatest({0}2, {1}2))".format(a, b)


@query(f"""with b as (select n_nationkey as k, 0.0 as a1, 0.0 as a2, 6 + n_nationkey % 3 as a3, 8 + n_nationkey % 5 as a4, 2 + n_nationkey % 3 as b1, 3 + n_nationkey % 4 as b2, 9 + n_nationkey % 3 as b3, 12 + n_nationkey % 4 as b4, 1 as c1, 1 as c2, 4 + n_nationkey % 2 as c3, 5 as c4 from nation),
d as (select *, greatest(a1, b1) as d1, greatest(a2, b2) as d2, least(a3, b3) as d3, least(a4, b4) as d4 from b)
select k as relation, round((a3 - a1) * (a4 - a2) + (b3 - b1) * (b4 - b2) - {_INTER('a', 'b')} - ({_INTER('c', 'a')} + {_INTER('c', 'b')} - {_INTER('c', 'd')}), 6) as area from d""")
def folded_areas(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("n"))
    k = F.col("n")
    boxes = [("outer", 0, 0, 6 + k % 3, 8 + k % 5), ("outer", 2 + k % 3, 3 + k % 4, 9 + k % 3, 12 + k % 4), ("inner", 1, 1, 4 + k % 2, 5)]
    corner = lambda way, i, lat, lon: F.struct((k * 100 + way * 10 + i).alias("id"), F.lit(lat).cast("double").alias("lat") if isinstance(lat, int) else lat.cast("double").alias("lat"), F.lit(lon).cast("double").alias("lon") if isinstance(lon, int) else lon.cast("double").alias("lon"))
    nodes = n.select(F.explode(F.array(*[corner(w, i, (s_, s_, n_, n_)[i], (w_, e_, e_, w_)[i]) for w, (_, s_, w_, n_, e_) in enumerate(boxes) for i in range(4)])).alias("c")).select("c.*")
    ways = n.select(F.explode(F.array(*[F.struct((k * 10 + w).alias("id"), F.array(*[k * 100 + w * 10 + i for i in (0, 1, 2, 3, 0)]).alias("nodes")) for w in range(3)])).alias("w")).select("w.*")
    members = F.array(*[F.struct((k * 10 + w).alias("id"), F.lit(boxes[w][0]).alias("role"), F.lit(1).alias("type")) for w in range(3)])
    rel = n.select(k.alias("id"), F.create_map(F.lit("place"), F.lit("city")).alias("tags"), members.alias("members"))
    got = places.relation_places(rel, ways, nodes, ["place"])
    return got.select(F.col("id").cast("int").alias("relation"), F.round(geo.rings_area(F.col("rings")), 6).alias("area"))


def drawn_shapes(spark, sf_dir):
    """(map, id, title, kind, rings): the customers' shapes by market segment, titled by nation."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("map"), F.concat(F.lit("Nation <"), F.col("c_nationkey").cast("string"), F.lit(">")).alias("title"))
    return customer_shapes(spark, sf_dir).join(c, "id")


_RING_POINT = "lat + case i when 1 then case when c_custkey % 3 = 1 then 7 else 8 end when 2 then case when c_custkey % 3 = 1 then 1 else 3 end else 0 end as lat, lon + case i when 1 then case when c_custkey % 3 = 1 then 1 else 2 end when 2 then case when c_custkey % 3 = 1 then 9 else 11 end else 0 end as lon"
DRAWN_SQL = f"""{CP_SQL}, v as (select c_custkey as id, c_mktsegment as map, c_nationkey as n, i, {_RING_POINT} from cp, (select unnest([0, 1, 2]) as i) where c_custkey % 3 <> 0 or i = 0),
w as (select map, (max(lat) + min(lat)) / 2 as cy, (max(lon) + min(lon)) / 2 as cx, least(800.0 / (radians(max(lon) - min(lon)) * 6371000.0 * cos(radians((max(lat) + min(lat)) / 2))), 600.0 / (radians(max(lat) - min(lat)) * 6371000.0)) as ratio from v group by map),
k as (select id, map, n, i, lat, lon from v where id % 3 <> 0 union all select id, map, n, j, lat + 10.0 / ratio / 111320.0 / 2 * sin(2 * pi() * (j % 16) / 16), lon + 10.0 / ratio / (40075000.0 * cos(radians(lat)) / 360) / 2 * cos(2 * pi() * (j % 16) / 16) from v join w using (map), unnest(range(0, 17)) as u(j) where id % 3 = 0),
q as (select id, map, n, 'M' || string_agg(printf('%.2f', radians(lon - cx) * 6371000.0 * cos(radians(cy)) * ratio + 400) || ',' || printf('%.2f', 300 - radians(lat - cy) * 6371000.0 * ratio), 'L' order by i) || case when id % 3 = 1 then '' else 'Z' end as path from k join w using (map) group by id, map, n),
m as (select map, 'nation' || n as key, 'Nation <' || n || '>' as title, string_agg(path, ' ' order by id) as path from q group by map, n)"""


@query(f"""with {DRAWN_SQL} select map, '<svg width="800" height="600">' || chr(10) || string_agg('<path d="' || path || '">' || chr(10) || '<title>' || replace(replace(title, '<', '&lt;'), '>', '&gt;') || '</title>' || chr(10) || '</path>', chr(10) order by key) || chr(10) || '</svg>' as svg from m group by map""")
def svg_documents(spark, sf_dir):
    return maps.svg_documents(drawn_shapes(spark, sf_dir), 800, 600)


@query(f"""with {DRAWN_SQL} select map, '{{"width":800,"height":600,"items":[' || string_agg('{{"key":"' || key || '","title":"' || title || '","path":"' || path || '"}}', ',' order by key) || ']}}' as json from m group by map""")
def map_documents(spark, sf_dir):
    return maps.map_documents(drawn_shapes(spark, sf_dir), 800, 600)


@query(f"with {AREA_SQL}, g as (select *, n_nationkey * 3.0::double - 40 as y, n_nationkey * 5.0::double - 60 as x from area) select n_nationkey, (south + north) / 2 as lat, (west + east) / 2 as lon, round((greatest(north, y) - least(south, y)) * (greatest(east, x) - least(west, x)), 6) as area from g")
def grown_boxes(spark, sf_dir):
    a = areas(spark, sf_dir).withColumn("b", F.struct("south", "west", "north", "east"))
    grown = geo.box_with(F.col("b"), F.col("n_nationkey") * F.lit(3.0) - 40, F.col("n_nationkey") * F.lit(5.0) - 60)
    a = a.select("n_nationkey", geo.box_centre(F.col("b")).alias("c"), geo.box_ring(grown).alias("ring"))
    return a.select("n_nationkey", "c.lat", "c.lon", F.round(F.abs(geo.ring_area(F.col("ring"))), 6).alias("area"))


@query(f"with {CP_SQL}, n as (select n_nationkey, n_nationkey * 5.0::double - 60 as y, 150 + n_nationkey * 2.0::double as west from nation) select c_custkey, n_nationkey from cp, n where lat > y and lat < y + 20 and (lon + case when west + 30 > 180 and lon < 0 then 360 else 0 end) > west and (lon + case when west + 30 > 180 and lon < 0 then 360 else 0 end) < west + 30")
def date_line_areas(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * F.lit(5.0) - 60.001).alias("y"), (150.001 + F.col("n_nationkey") * F.lit(2.0)).alias("west"))
    wrap = lambda x: F.when(x > 180, x - 360).otherwise(x)
    p = lambda dy, dx: F.struct((F.col("y") + dy).alias("lat"), wrap(F.col("west") + dx).alias("lon"))
    shapes = n.select("n_nationkey", F.array(F.array(p(0.002, 0), p(0.002, 29.998), p(20, 29.998), p(20, 0))).alias("rings"))
    return spatial.within_rings_over_date_line(customer_points(spark, sf_dir), shapes, "lat", "lon", 5.0).select("c_custkey", "n_nationkey")


def rings(spark, sf_dir):
    p = customer_points(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")))
    shape = F.transform(F.array_sort(F.collect_list(F.struct("rn", "lat", "lon"))), lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))
    return p.groupBy("c_nationkey").agg(shape.alias("ring"))


RING_SQL = f"""{CP_SQL}, o as (select c_nationkey, lat, lon, row_number() over (partition by c_nationkey order by c_custkey) as rn from cp), r as (select * from o),
s as (select *, coalesce(lead(lat) over w, first_value(lat) over w) as lat2, coalesce(lead(lon) over w, first_value(lon) over w) as lon2 from r window w as (partition by c_nationkey order by rn))"""


@query(f"with {RING_SQL} select c_nationkey, case when abs(sum(lon * lat2 - lon2 * lat)) < 0.0001 then 0.0 else round(sum(lon * lat2 - lon2 * lat) / 2, 4) end as area from s group by c_nationkey")
def polygon_area(spark, sf_dir):
    return _areas_of(rings(spark, sf_dir))


def _areas_of(r):
    area = geo.ring_area(F.col("ring"))
    return r.select("c_nationkey", F.when(F.abs(area) < 0.00005, 0.0).otherwise(F.round(area, 4)).alias("area"))  # no negative zero


@query(f"with {RING_SQL}, a as (select c_nationkey, sum(lon * lat2 - lon2 * lat) / 2 as area, sum((lat + lat2) * (lon * lat2 - lon2 * lat)) as y, sum((lon + lon2) * (lon * lat2 - lon2 * lat)) as x from s group by c_nationkey) select c_nationkey, round(y / (6 * area), 4) as lat, round(x / (6 * area), 4) as lon from a where abs(area) > 1")
def centroid(spark, sf_dir):
    from .plans.places import area_centroid

    r = rings(spark, sf_dir).where(F.abs(geo.ring_area(F.col("ring"))) > 1).withColumn("c", area_centroid(F.col("ring")))
    return r.select("c_nationkey", F.round("c.lat", 4).alias("lat"), F.round("c.lon", 4).alias("lon"))


@query(f"with {CP_SQL} select c_nationkey, min(lat) as south, min(lon) as west, max(lat) as north, max(lon) as east from cp group by c_nationkey")
def bbox_agg(spark, sf_dir):
    return customer_points(spark, sf_dir).groupBy("c_nationkey").agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))


@query(f"with {CP_SQL} select c_custkey, case when lon < 0 then lon + 360 else lon end as lon from cp")
def shift_longitude(spark, sf_dir):
    return customer_points(spark, sf_dir).select("c_custkey", geo.shift_longitude(F.col("lon")).alias("lon"))


@query(f"""with {CP_SQL}, o as (select c_nationkey, row_number() over (partition by c_nationkey order by c_custkey) as rn, radians(lon - 10.0) * 6371000.0 * cos(radians(20.0)) * 0.001 + 400 as x, 300 - radians(lat - 20.0) * 6371000.0 * 0.001 as y from cp)
select c_nationkey, 'M' || string_agg(printf('%.2f', x) || ' ' || printf('%.2f', y), ' L' order by rn) || ' Z' as path from o group by c_nationkey""")
def svg_path(spark, sf_dir):
    return _paths_of(_customer_rows(spark, sf_dir))


def _customer_rows(spark, sf_dir):
    return customer_points(spark, sf_dir).withColumn("rn", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")))


def _paths_of(p):
    x, y = geo.to_screen(F.col("lat"), F.col("lon"), F.lit(20.0), F.lit(10.0), 0.001, 800, 600)
    pts = p.select("c_nationkey", "rn", x.alias("x"), y.alias("y")).groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "x", "y"))), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("pts"))
    return pts.select("c_nationkey", render.svg_path(F.col("pts"), closed=True).alias("path"))


@query(f"""with {CP_SQL} select lower(regexp_replace(c_mktsegment, '[^\\w]+', '', 'g')) as key, cast(floor(min(lon)) as bigint) as "left", cast(floor(min(lat)) as bigint) as top, cast(ceil(max(lon)) as bigint) as "right", cast(ceil(max(lat)) as bigint) as bottom, min(c_mktsegment) as title,
  string_agg('p' || c_custkey, ' ' order by c_custkey) as path from cp group by 1""")
def title_group(spark, sf_dir):
    rows = customer_points(spark, sf_dir).select("c_mktsegment", "c_custkey", F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("path"), F.col("lon").alias("l"), F.col("lat").alias("t"), F.col("lon").alias("r"), F.col("lat").alias("b"))
    return render.title_groups(rows, "c_mktsegment", "path", ["l", "t", "r", "b"], ["c_custkey"])


@query(f"with {CP_SQL} select cast(floor(min(lon)) as bigint) as \"left\", cast(floor(min(lat)) as bigint) as top, cast(ceil(max(lon) - min(lon)) as bigint) as width, cast(ceil(max(lat) - min(lat)) as bigint) as height from cp")
def rect_union(spark, sf_dir):
    p = customer_points(spark, sf_dir)
    return p.agg(F.floor(F.min("lon")).alias("left"), F.floor(F.min("lat")).alias("top"), F.ceil(F.max("lon") - F.min("lon")).alias("width"), F.ceil(F.max("lat") - F.min("lat")).alias("height"))


# ---- search -----------------------------------------------------------------------------------------------------------


@query("""select p_partkey, p_brand, array_to_string(list_transform(regexp_extract_all(p_brand, '\\d+|\\D+'), lambda x: case when regexp_matches(x, '^\\d+$') then lpad(x, cast(greatest(12, length(x)) as integer), '0') else x end), '') as sorting from part""")
def natural_sort(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", tx.natural_key(F.col("p_brand")).alias("sorting"))


def part_index(spark, sf_dir):
    return search.postings(table(spark, sf_dir, "part"), "p_partkey", ["p_name"])


@query(r"""select p_partkey, p_name from part where regexp_matches(lower(p_name), '(^|[^\p{L}\p{N}.+&-])sm') and regexp_matches(lower(p_name), '(^|[^\p{L}\p{N}.+&-])gi') order by p_partkey limit 50""")
def prefix_search(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    hit = search.match(part_index(spark, sf_dir), "sm* gi")
    return part.join(hit, part["p_partkey"] == hit["doc_id"], "left_semi").select("p_partkey", "p_name").orderBy("p_partkey").limit(50)


@query(f"""with recursive {REGISTRY_SQL},
up as (select id, parent, {TITLE_SQL} as full_title from reg where parent is null
  union all select r.id, r.parent, u.full_title || ', ' || case when r.level > 1 then r.type || ' ' || r.name else r.name end from reg r join up u on r.parent = u.id)
select id, full_title from up where regexp_matches(lower(full_title), '^[^,]*,[^,]*nation.*,.*customer') order by length(full_title), id limit 20""")
def ordered_parts_search(spark, sf_dir):
    t = registry_full_title(spark, sf_dir).select("id", "full_title")
    hit = search.match(search.postings(t, "id", ["full_title"]), "nation, customer")
    return t.join(hit, t["id"] == hit["doc_id"], "left_semi").orderBy(F.length("full_title"), "id").limit(20)


@query(r"""select p_partkey, p_name from part where regexp_matches(lower(p_name), 'izm') and regexp_matches(lower(p_name), 'old')""")
def infix_search(spark, sf_dir):
    index, part = part_index(spark, sf_dir), table(spark, sf_dir, "part")
    hit = search.match(index, "*izm* old", mode="infix", gram_index=search.grams(index))
    return part.join(hit, part["p_partkey"] == hit["doc_id"], "left_semi").select("p_partkey", "p_name")


#: Forms of two words, by part number; each query word below has another form still.
STREETS, BIG = ["улица", "улицы", "улице", "улицей", "улей", "улицах"], ["большая", "большой", "большие", "болтливый", "большую"]


@query("select p_partkey from part where p_partkey % 6 <> 4 and p_partkey % 5 <> 3")
def stem_search(spark, sf_dir):
    of = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("p_partkey") % len(words) + 1).cast("int"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(", ", "p_brand", F.concat_ws(" ", of(BIG), of(STREETS)), "p_type").alias("title"))
    hit = search.match(search.postings(part, "p_partkey", ["title"], stems=True), "больших улицам", mode="stem")
    return hit.select(F.col("doc_id").alias("p_partkey"))


@query(f"""with recursive {REGISTRY_SQL},
up as (select id, parent, {TITLE_SQL} as full_title from reg where parent is null
  union all select r.id, r.parent, u.full_title || ', ' || case when r.level > 1 then r.type || ' ' || r.name else r.name end from reg r join up u on r.parent = u.id),
p as (select id, i, list_filter(regexp_split_to_array(lower(string_split(full_title, ',')[i]), '[^\\p{{L}}\\p{{N}}-]+'), lambda x: x <> '') as words from up, unnest(range(1, len(string_split(full_title, ',')) + 1)) as u(i)),
s as (select *, coalesce(sum(len(words) + 100) over (partition by id order by i rows between unbounded preceding and 1 preceding), 0) as start from p)
select id as doc_id, cast(start + k - 1 as bigint) as pos, words[k] as term from s, unnest(range(1, len(words) + 1)) as v(k)""")
def comma_positions(spark, sf_dir):
    titles = registry_full_title(spark, sf_dir).select("id", "full_title")
    return search.postings(titles, "id", ["full_title"]).select("doc_id", "pos", "term")


@query("""select p_partkey, array_to_string(list_transform(string_split(lower(replace(p_name, 'ring', 'ул.')), ' '), lambda x: case x when 'ул.' then 'улица' when 'gear' then 'часть' else x end), ' ') as folded from part""")
def wordform_fold(spark, sf_dir):
    c = F.regexp_replace("p_name", "ring", "ул.")
    return table(spark, sf_dir, "part").select("p_partkey", tx.replace_words(c, {"ул.": "улица", "gear": "часть"}).alias("folded"))


@query("""with d as (select *, row_number() over (partition by lower(p_brand || p_type) order by p_retailprice, p_partkey) as rn from part) select p_partkey, p_brand, p_type, p_retailprice from d where rn = 1 order by p_retailprice, p_partkey limit 30""")
def dedup_topk(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice", F.concat("p_brand", "p_type").alias("title"))
    return search.dedup_topk(p, "title", ["p_retailprice", "p_partkey"], 30).drop("title")


def customer_bags(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"])
    pairs = [("addr:region", F.col("n_name")), ("addr:city", F.when(F.col("c_custkey") % 3 != 0, F.upper("n_name"))), ("addr:street", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))), ("addr:housenumber", F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey").cast("string"))),
             ("addr2:street", F.when(F.col("c_custkey") % 8 == 0, F.lit("Side"))), ("addr2:housenumber", F.when(F.col("c_custkey") % 8 == 0, F.lit("2")))]
    return j.select("c_custkey", F.map_filter(F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)]), lambda _, v: v.isNotNull()).alias("tags"))


CB_SQL = """cb as (select c_custkey, n_name as country, case when c_custkey % 3 <> 0 then upper(n_name) end as city, case when c_custkey % 2 = 0 then c_mktsegment end as street, case when c_custkey % 4 = 0 then cast(c_custkey as varchar) end as number from customer join nation on c_nationkey = n_nationkey)"""


@query(f"with {CB_SQL} select c_custkey, concat_ws(', ', country, case when lower(city) <> lower(country) then city end, street, number) as title from cb")
def doc_title(spark, sf_dir):
    return customer_bags(spark, sf_dir).select("c_custkey", docs_plan.title(F.col("tags")).alias("title"))


@query(f"with {CB_SQL} select c_custkey, cast(case when number is not null then 66 when street is not null then 64 when city is not null then 5 else 2 end as integer) as priority from cb")
def doc_priority(spark, sf_dir):
    return customer_bags(spark, sf_dir).select("c_custkey", docs_plan.priority(F.col("tags")).alias("priority"))


@query(f"""with {CB_SQL}, {CP_SQL} select cb.c_custkey as id, concat_ws(', ', country, case when lower(city) <> lower(country) then city end, street, number) || case when cb.c_custkey % 8 = 0 then ' / Side, 2' else '' end as title,
  cast(case when number is not null then 66 when street is not null then 64 when city is not null then 5 else 2 end as integer) as priority, cast(case when number is not null then 1 else 0 end as integer) as custom_level, 0 as building, lat, lon
from cb join cp on cb.c_custkey = cp.c_custkey""")
def address_documents(spark, sf_dir):
    shapes = customer_points(spark, sf_dir).select(F.col("c_custkey").alias("id"), F.lit("point").alias("kind"), F.array(F.array(F.struct("lat", "lon"))).alias("rings"))
    docs = docs_plan.documents_of(customer_bags(spark, sf_dir).withColumnRenamed("c_custkey", "id"), shapes)
    return docs.select("id", "title", "priority", "custom_level", "building", "lat", "lon")


@query(f"""with {CB_SQL}, {CP_SQL}, d as (select cb.c_custkey as id, concat_ws(', ', country, case when lower(city) <> lower(country) then city end, street, number) || case when cb.c_custkey % 8 = 0 then ' / Side, 2' else '' end as title, {HAV('lat', 'lon', '48.85', '2.35')} as distance from cb join cp on cb.c_custkey = cp.c_custkey)
select id, title, round(distance, 3) as distance from (select *, row_number() over (partition by lower(title) order by distance, id) as rn from d) where rn = 1 order by distance, id limit 20""")
def reverse_geocode(spark, sf_dir):
    shapes = customer_points(spark, sf_dir).select(F.col("c_custkey").alias("id"), F.lit("point").alias("kind"), F.array(F.array(F.struct("lat", "lon"))).alias("rings"))
    docs = docs_plan.documents_of(customer_bags(spark, sf_dir).withColumnRenamed("c_custkey", "id"), shapes)
    return search.reverse_geocode(docs, 48.85, 2.35).select("id", "title", F.round("distance", 3).alias("distance"))


@query("""with o as (select 'R' || r_regionkey as guid, cast(null as varchar) as parent, r_name as title from region union all select 'N' || n_nationkey, 'R' || n_regionkey, 'country ' || n_name from nation where n_nationkey % 7 <> 0),
h as (select 'C' || c_custkey as guid, 'N' || c_nationkey as parent, concat_ws(' ', 'house', cast(c_custkey as varchar), case when c_custkey % 2 = 0 then 'к' || (c_custkey % 5) end, case when c_custkey % 3 = 0 then 'с' || (c_custkey % 4) end) as title,
  case when c_custkey % 4 = 0 then cast(100000 + c_custkey as varchar) end as code from customer where c_custkey % 11 <> 0),
d as (select o.guid, concat_ws(', ', p.title, o.title) as title, 0 as building from o left join o p on p.guid = o.parent union all select h.guid, concat_ws(', ', h.code, r.title, n.title, h.title), 1 from h left join o n on n.guid = h.parent left join o r on r.guid = n.parent)
select guid, title, building, cast(len(string_split(title, ',')) as integer) as priority from d""")
def fias_documents(spark, sf_dir):
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    r = table(spark, sf_dir, "region").select(text("R", "r_regionkey").alias("aoguid"), F.lit(None).cast("string").alias("parentguid"), F.lit(1).alias("aolevel"), F.lit("reg").alias("shortname"), F.col("r_name").alias("offname"), F.lit("x").alias("formalname"), F.lit(1).alias("livestatus"))
    n = table(spark, sf_dir, "nation").select(text("N", "n_nationkey"), text("R", "n_regionkey"), F.lit(3), F.lit("c"), F.col("n_name"), F.lit("x"), F.when(F.col("n_nationkey") % 7 == 0, 0).otherwise(1))
    types = r.select("aolevel").limit(1).select(F.explode(F.array(*[F.struct(F.lit(s_).alias("scname"), F.lit(l_).alias("level"), F.lit(t_).alias("socrname")) for s_, l_, t_ in (("reg", 1, "region"), ("c", 3, "country"), ("c", 4, "city"))])).alias("t")).select("t.*")
    k, day = F.col("c_custkey"), lambda d: F.lit(d).cast("date")
    house = table(spark, sf_dir, "customer").select(
        text("C", "c_custkey").alias("houseguid"), text("N", "c_nationkey").alias("aoguid"), F.lit(2).alias("eststatus"), k.cast("string").alias("housenum"), F.when(k % 2 == 0, (k % 5).cast("string")).alias("buildnum"), F.when(k % 3 == 0, (k % 4).cast("string")).otherwise("").alias("strucnum"),
        F.when(k % 4 == 0, (k + 100000).cast("string")).alias("postalcode"), day("2000-01-01").alias("startdate"), F.when(k % 11 == 0, day("2010-01-01")).otherwise(day("2079-06-06")).alias("enddate"),
    )
    kinds = house.limit(1).select(F.lit(2).alias("eststatid"), F.lit("house").alias("name"))
    return registers.documents([registers.fias_objects(r.union(n), types), registers.fias_houses(house, kinds, F.lit("2020-01-01").cast("date"))], depth=4)


@query("""with o as (select r_regionkey + 1000 as id, cast(null as bigint) as parent, 'область ' || r_name as title from region union all select n_nationkey + 2000, n_regionkey + 1000, n_name from nation where n_nationkey % 7 <> 0),
h as (select c_custkey + 10000 as id, c_nationkey + 2000 as parent, concat_ws(' ', case c_custkey % 3 when 0 then 'дом' when 1 then 'корпус' end, cast(c_custkey as varchar)) as title from customer where c_custkey % 5 <> 0),
m as (select o_orderkey + 1000000 as id, o_custkey + 10000 as parent, 'помещение ' || (o_orderkey % 90) as title from orders where o_orderkey % 20 = 1),
d as (select o.id, concat_ws(', ', p.title, o.title) as title, 0 as building from o left join o p on p.id = o.parent
  union all select h.id, concat_ws(', ', r.title, n.title, h.title), 1 from h left join o n on n.id = h.parent left join o r on r.id = n.parent
  union all select m.id, concat_ws(', ', r.title, n.title, h.title, m.title), 2 from m left join h on h.id = m.parent left join o n on n.id = h.parent left join o r on r.id = n.parent)
select cast(id as varchar) as guid, title, building, cast(len(string_split(title, ',')) as integer) as priority from d""")
def gar_documents(spark, sf_dir):
    one, id_ = F.lit(1), lambda c, by: (F.col(c) + by).cast("bigint")
    row = lambda df, i, *more: df.select(i.alias("OBJECTID"), *more, one.alias("ISACTUAL"))
    region, nation, customer, orders = (table(spark, sf_dir, n) for n in ("region", "nation", "customer", "orders"))
    objects = row(region, id_("r_regionkey", 1000), F.col("r_name").alias("NAME"), F.lit("обл").alias("TYPENAME"), F.lit("1").alias("LEVEL"), one.alias("ISACTIVE")).unionByName(
        row(nation, id_("n_nationkey", 2000), F.col("n_name").alias("NAME"), F.lit("нет").alias("TYPENAME"), F.lit("5").alias("LEVEL"), F.when(F.col("n_nationkey") % 7 == 0, 0).otherwise(1).alias("ISACTIVE"))
    )
    houses = row(customer, id_("c_custkey", 10_000), F.col("c_custkey").cast("string").alias("HOUSENUM"), (F.col("c_custkey") % 3).cast("int").alias("HOUSETYPE"), F.when(F.col("c_custkey") % 5 == 0, 0).otherwise(1).alias("ISACTIVE"))
    rooms = row(orders.where("o_orderkey % 20 = 1"), id_("o_orderkey", 1_000_000), (F.col("o_orderkey") % 90).cast("string").alias("NUMBER"), F.lit(1).alias("ROOMTYPE"), one.alias("ISACTIVE"))
    link = lambda df, i, up: df.select(i.alias("OBJECTID"), up.alias("PARENTOBJID"), one.alias("ISACTIVE"))
    links = link(nation, id_("n_nationkey", 2000), id_("n_regionkey", 1000)).unionByName(link(customer, id_("c_custkey", 10_000), id_("c_nationkey", 2000))).unionByName(link(orders, id_("o_orderkey", 1_000_000), id_("o_custkey", 10_000)))
    types = region.limit(1).select(F.explode(F.array(*[F.struct(F.lit(a_).alias("SHORTNAME"), F.lit(b_).alias("LEVEL"), F.lit(c_).alias("NAME")) for a_, b_, c_ in (("обл", "1", "область"), ("обл", "2", "x"))])).alias("t")).select("t.*")
    kinds = lambda *names: region.limit(1).select(F.posexplode(F.array(*map(F.lit, names))).alias("ID", "NAME"))
    levels = [registers.gar_objects(objects, types, links), registers.gar_numbered(houses, links, "HOUSENUM", 1, kinds("дом", "корпус"), "HOUSETYPE"), registers.gar_numbered(rooms, links, "NUMBER", 2, kinds("", "помещение"), "ROOMTYPE")]
    return registers.documents(levels, depth=4)


@query("select c_custkey, case when c_custkey % 8 = 0 then ' / Side, 2' else '' end as alternatives from customer")
def alt_addresses(spark, sf_dir):
    return customer_bags(spark, sf_dir).select("c_custkey", docs_plan.alternatives(F.col("tags")).alias("alternatives"))


# ---- requests and routes ----------------------------------------------------------------------------------------------


@query("""select distinct case upper(ref[1]) when 'R' then 'relation' when 'W' then 'way' else 'node' end as type, cast(ref[2:] as bigint) as id
from (select substr('RrWwNn', cast(o_orderkey % 6 as int) + 1, 1) || o_custkey as ref from orders)""")
def map_id_refs(spark, sf_dir):
    letter = F.substring(F.lit("RrWwNn"), (F.col("o_orderkey") % 6 + 1).cast("int"), F.lit(1))
    refs = table(spark, sf_dir, "orders").select(F.upper(F.concat(letter, F.col("o_custkey"))).alias("ref")).distinct()
    return refs.select(requests.map_id(F.col("ref")).alias("r")).select("r.type", "r.id")


@query("""select c_custkey, least(a, d) as south, least(b, e) as west, greatest(a, d) as north, greatest(b, e) as east
from (select c_custkey, c_custkey % 90 / 2.0::double as a, c_custkey % 180 / 4.0::double as b, c_nationkey / 1.0::double as d, c_nationkey * 2 / 1.0::double as e from customer) where c_custkey % 5 <> 0
union all select c_custkey, null, null, null, null from customer where c_custkey % 5 = 0""")
def box_texts(spark, sf_dir):
    half = lambda c, by: (c / F.lit(by)).cast("string")
    corners = [half(F.col("c_custkey") % 90, 2.0), half(F.col("c_custkey") % 180, 4.0), half(F.col("c_nationkey"), 1.0), half(F.col("c_nationkey") * 2, 1.0)]
    text = F.when(F.col("c_custkey") % 5 == 0, F.lit("55.7,x, 1,2")).otherwise(F.concat_ws(", ", *corners))
    return table(spark, sf_dir, "customer").select("c_custkey", requests.parse_box(text).alias("b")).select("c_custkey", "b.south", "b.west", "b.north", "b.east")


@query("""select l_orderkey, l_linenumber, l_partkey % 3 <> l_suppkey % 3 or (l_linenumber % 6 in (1, 4) and l_quantity > 25) or (l_linenumber % 6 in (2, 5) and l_quantity < 25) as search
from lineitem""")
def same_edge(spark, sf_dir):
    search_needed = routing.needs_search(F.col("l_partkey") % 3, F.col("l_quantity"), F.col("l_suppkey") % 3, F.lit(25), F.col("l_linenumber") % 6)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", search_needed.alias("search"))


@query("""with e as (select o_custkey as route, 0 as part, o_orderkey as k, '{"type":"Feature","name":"ShapeMeta","geometry":{"type":"LineString","coordinates":[' ||
case when o_orderkey % 2 = 0 then p || ',' || q else q || ',' || p end || ']},"properties":{"status":"' || o_orderstatus || '"}}' as feature
from (select *, '[' || (o_orderkey * 91 % 720 / 4.0::double - 90)::varchar || ',' || (o_orderkey * 37 % 340 / 4.0::double - 42.5)::varchar || ']' as p,
'[' || (o_custkey * 91 % 720 / 4.0::double - 90)::varchar || ',' || (o_custkey * 37 % 340 / 4.0::double - 42.5)::varchar || ']' as q from orders)),
s as (select c_custkey as route, 1 as part, 0 as k, '{"type":"Feature","name":"Stop","Shape":"0","geometry":{"type":"Point","coordinates":[' ||
(c_custkey * 91 % 720 / 4.0::double - 90)::varchar || ',' || (c_custkey * 37 % 340 / 4.0::double - 42.5)::varchar || ']},"properties":{}}' as feature from customer)
select route, '{"type":"FeatureCollection","features":[' || string_agg(feature, ',' order by part, k) || ']}' as geojson from (select * from e union all select * from s) group by route""")
def route_features(spark, sf_dir):
    lat = lambda key: (F.col(key) * 37 % 340) / F.lit(4.0) - 42.5
    lon = lambda key: (F.col(key) * 91 % 720) / F.lit(4.0) - 90
    at = lambda key: F.struct(lat(key).alias("lat"), lon(key).alias("lon"))
    o = table(spark, sf_dir, "orders")
    edges = o.select(F.col("o_custkey").alias("route"), F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 2 == 0).alias("forward"), F.array(at("o_orderkey"), at("o_custkey")).alias("shape"), F.create_map(F.lit("status"), "o_orderstatus").alias("attributes"))
    none = F.lit(None).cast("map<string,string>").alias("attributes")
    stops = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("route"), F.lit(0).cast("bigint").alias("k"), F.lit(0).alias("shape_index"), lat("c_custkey").alias("lat"), lon("c_custkey").alias("lon"), none)
    return render.route_geojson(edges, stops)


def stitched(spark, sf_dir):
    """Stitched routes of five edges a customer; every other edge is stored against its way."""
    c = F.col("c_custkey")
    lat = lambda node: (node * 37 % 340) / F.lit(4.0) - 42.5
    lon = lambda node: (node * 91 % 720) / F.lit(4.0) - 90
    at = lambda y, x: F.struct(y.alias("lat"), x.alias("lon"))
    k = F.col("k")
    e = table(spark, sf_dir, "customer").select(c.alias("route"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    e = e.withColumns({"u": (F.col("route") * 7 + k * 13) % 5000, "v": (F.col("route") * 7 + (k + 1) * 13) % 5000, "flip": (F.col("route") + k) % 2 == 1})
    u, v, flip = F.col("u"), F.col("v"), F.col("flip")
    way = F.array(at(lat(u), lon(u)), at(lat(u) + 0.25, lon(v) - 0.5), at(lat(v), lon(v)))
    e = e.select("route", "k", F.when(flip, v).otherwise(u).alias("from_node"), F.when(flip, u).otherwise(v).alias("to_node"), F.when(flip, F.reverse(way)).otherwise(way).alias("shape"), F.create_map(F.lit("class"), (F.floor(k / 2)).cast("string"), F.lit("side"), (F.col("route") % 2).cast("string")).alias("attributes"))
    ends = table(spark, sf_dir, "customer").select(
        c.alias("route"), (lat(c) + 0.5).alias("s_lat"), (lon(c) + 0.75).alias("s_lon"), F.when(c % 2 == 1, 2).otherwise(1).alias("s_offset"), (lat(c) - 0.5).alias("t_lat"), (lon(c) - 0.75).alias("t_lon"), F.when((c + 4) % 2 == 1, 1).otherwise(2).alias("t_offset"),
    )
    return stitch.stitch(e, ends)


STITCH_SQL = """s as (select c_custkey as route, k, (c_custkey * 7 + k * 13) % 5000 as u, (c_custkey * 7 + (k + 1) * 13) % 5000 as v from customer, (select unnest([0, 1, 2, 3, 4]) as k)),
w as (select route, k, u * 37 % 340 / 4.0::double - 42.5 as uy, u * 91 % 720 / 4.0::double - 90 as ux, v * 37 % 340 / 4.0::double - 42.5 as vy, v * 91 % 720 / 4.0::double - 90 as vx from s),
p as (select route, k, 1 as i, uy + 0.25 as y, vx - 0.5 as x from w union all select route, k, 2, vy, vx from w where k < 4
  union all select c_custkey, 0, 0, c_custkey * 37 % 340 / 4.0::double - 42.5 + 0.5, c_custkey * 91 % 720 / 4.0::double - 90 + 0.75 from customer union all select c_custkey, 4, 3, c_custkey * 37 % 340 / 4.0::double - 42.5 - 0.5, c_custkey * 91 % 720 / 4.0::double - 90 - 0.75 from customer),
q as (select *, '[' || x::varchar || ',' || y::varchar || ']' as xy, row_number() over (partition by route order by k, i) - 1 as n from p),
m as (select route, k // 2 as run, min(n) as n, '{"class":"' || (k // 2) || '","side":"' || (route % 2) || '"}' as a from q group by route, k // 2),
z as (select route, string_agg(xy, ',' order by n) as shape, max(n) as last, first(xy order by n) as src, last(xy order by n) as dst from q group by route)"""


@query(f"""with {STITCH_SQL}, j as (select route, string_agg('{{"Shape":' || n || ',"Attributes":' || a || '}}', ',' order by n) as meta from m group by route)
select route, '{{"Shape":[' || shape || '],"ShapeMeta":[' || meta || '],"Stops":[{{"Shape":0,"Coordinates":' || src || '}},{{"Shape":' || last || ',"Coordinates":' || dst || '}}]}}' as json from z join j using (route)""")
def route_documents(spark, sf_dir):
    return stitch.route_json(stitched(spark, sf_dir))


@query(f"""with {STITCH_SQL}, t as (select m.route, m.n, m.a, coalesce(lead(m.n) over (partition by m.route order by m.n), z.last) as stop from m join z using (route)),
l as (select t.route, t.n, '{{"type":"Feature","name":"ShapeMeta","geometry":{{"type":"LineString","coordinates":[' || string_agg(q.xy, ',' order by q.n) || ']}},"properties":' || any_value(t.a) || '}}' as f from t join q on q.route = t.route and q.n between t.n and t.stop group by t.route, t.n)
select route, '{{"type":"FeatureCollection","features":[' || string_agg(f, ',' order by n) || ',{{"type":"Feature","name":"Stop","Shape":"0","geometry":{{"type":"Point","coordinates":' || any_value(src) || '}},"properties":{{}}}},{{"type":"Feature","name":"Stop","Shape":"' || any_value(last) || '","geometry":{{"type":"Point","coordinates":'
 || any_value(dst) || '}},"properties":{{}}}}]}}' as geojson from l join z using (route) group by route""")
def route_lines(spark, sf_dir):
    return stitch.route_geojson(stitched(spark, sf_dir))


# ---- without SQL ------------------------------------------------------------------------------------------------------


@query()
def convex_hull(spark, sf_dir):
    return rings(spark, sf_dir).select("c_nationkey", render.hull("ring").alias("hull")).select("c_nationkey", F.size("hull").alias("n_points"), geo.ring_area(F.col("hull")).alias("area"))


@query()
def simplified_lines(spark, sf_dir):
    return rings(spark, sf_dir).select("c_nationkey", F.size("ring").alias("n_before"), F.size(render.simplify(500_000.0)("ring")).alias("n_after"))


@query()
def packed_titles(spark, sf_dir):
    t = registry_full_title(spark, sf_dir).select("id", "full_title", render.pack("full_title").alias("packed"))
    return t.select("id", "packed", (render.unpack("packed") == F.col("full_title")).alias("same"))


@query()
def geojson_lines(spark, sf_dir):
    r = rings(spark, sf_dir).select("c_nationkey", render.geojson_line(F.col("ring"), F.struct(F.col("c_nationkey").alias("nation"))).alias("feature"))
    return render.geojson_collection(r.withColumn("one", F.lit(1)), "feature", ["one"], ["c_nationkey"]).drop("one")


# These are held against brute force as well; centroid_whole also has the rings without an area.


@query()
def shared_node_pairs_whole(spark, sf_dir):
    return graph.shared_node_pairs(ways(spark, sf_dir))


@query()
def restriction_lift_whole(spark, sf_dir):
    return _lifted(table(spark, sf_dir, "lineitem"))


@query()
def polygon_area_whole(spark, sf_dir):
    return _areas_of(rings(spark, sf_dir))


@query()
def centroid_whole(spark, sf_dir):
    from .plans.places import area_centroid

    r = rings(spark, sf_dir).withColumn("c", F.when(F.abs(geo.ring_area(F.col("ring"))) > 0.00005, area_centroid(F.col("ring"))))  # rings without area have none
    return r.select("c_nationkey", F.round("c.lat", 4).alias("lat"), F.round("c.lon", 4).alias("lon"))


@query()
def svg_path_whole(spark, sf_dir):
    return _paths_of(_customer_rows(spark, sf_dir))
