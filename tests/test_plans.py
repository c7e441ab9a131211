import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from terrane.operators import changes, hierarchy, spatial
from terrane.plans import documents, graph, places, render, routing, search, vehicle
from terrane.sources import osm_pbf, registry_files
from terrane.streaming import jobs


def test_hierarchy_survives_cycles_and_missing_parents(spark):
    df = spark.createDataFrame([("a", None, "A"), ("b", "a", "B"), ("c", "b", "C"), ("x", "y", "X"), ("p", "q", "P"), ("q", "p", "Q")], "id string, parent string, title string")
    got = {r.id: r.full_title for r in hierarchy.full_titles(df, "id", "parent", "title", 4).collect()}
    assert got["c"] == "A, B, C" and got["x"] == "X" and len(got) == 6
    assert {r.id for r in hierarchy.roots(df, "id", "parent").collect()} == {"a", "x"}
    assert {r.id for r in hierarchy.leaves(df, "id", "parent").collect()} == {"c", "x"}


def test_changes(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], "k int, v string, n int")
    delta = spark.createDataFrame([(2, "x", 2), (2, "y", 3), (4, "d", 2)], "k int, v string, n int")
    assert sorted(map(tuple, changes.latest_wins(base, delta, ["k"], "n").collect())) == [(1, "a", 1), (2, "y", 3), (3, "c", 1), (4, "d", 2)]
    assert sorted(map(tuple, changes.first_wins(base, delta, ["k"], ["n"]).collect())) == [(1, "a", 1), (2, "b", 1), (3, "c", 1), (4, "d", 2)]
    assert {r.k for r in changes.without(base, delta, ["k"]).collect()} == {1, 3}
    assert changes.since(base, "k", 1, 2).count() == 1 and changes.since(base, "k", 1, full=True).count() == 3
    assert changes.blank_to_null(spark.createDataFrame([("", 1)], "s string, n int")).first().s is None


def test_grid_join_equals_nested_loops(spark):
    points = spark.range(400).select("id", (F.col("id") * 7 % 90 - 45.0).alias("lat"), (F.col("id") * 13 % 180 - 90.0).alias("lon"))
    areas = spark.range(20).select(F.col("id").alias("area"), (F.col("id") * 4 - 40.0).alias("south"), (F.col("id") * 8 - 80.0).alias("west")).selectExpr("*", "south + 9 as north", "west + 21 as east")
    got = {(r.id, r.area) for r in spatial.within_boxes(points, areas, "lat", "lon", 3.5).collect()}
    want = {(p.id, a.area) for p in points.collect() for a in areas.collect() if a.south <= p.lat <= a.north and a.west <= p.lon <= a.east}
    assert got == want and want


def test_search_orders_parts_and_dedups(spark):
    rows = [(1, "Москва, улица Ёлкина, 5"), (2, "москва, улица ёлкина, 5"), (3, "Ёлкина площадь, Москва"), (4, "Тверь, улица Мира")]
    docs = spark.createDataFrame(rows, "id int, title string").selectExpr("*", "title as custom_title", "id as priority", "title as sorting", "1 as custom_level", "map('k', cast(id as string)) as data")
    index = search.postings(docs, "id", ["title"])
    assert {r.doc_id for r in search.match(index, "моск, елк").collect()} == {1, 2}
    assert {r.doc_id for r in search.match(index, "елк* москва").collect()} == {1, 2, 3}
    assert search.match(index, " , ").count() == 0
    assert [r.id for r in search.search(docs, index, "москва, елкина").collect()] == [1]
    assert [r.id for r in search.search(docs, index, "москва, елкина", raw=True, wanted=[{"k": "2"}, {"k": "9"}]).collect()] == [2]


def test_documents(spark):
    bag = F.create_map(*[F.lit(x) for x in ("addr:city", "Tver", "addr:town", "tver", "addr:street", "Mira", "addr:housenumber", "1", "addr2:street", "Side", "addr2:housenumber", "2")])
    r = spark.range(1).select(documents.title(bag).alias("t"), documents.alternatives(bag).alias("a"), documents.priority(bag).alias("p")).first()
    assert (r.t, r.a, r.p) == ("Tver, Mira, 1", " / Side, 2", 66)


@pytest.mark.parametrize(
    "tags, want",
    [
        ({"highway": "motorway"}, (3.6 / 120, 3)), ({"highway": "primary", "maxspeed": "60", "oneway": "-1"}, (3.6 / 45, 2)), ({"highway": "primary", "maxspeed": "30 mph"}, (3.6 / 90, 0)),
        ({"highway": "x", "route": "ferry"}, (3.6 / 5, 0)), ({"highway": "residential", "junction": "roundabout"}, (3.6 / 50, 1)), ({"highway": "residential", "access": "private", "motorcar": "yes"}, (3.6 / 50, 0)),
        ({"highway": "residential", "access": "no"}, (None, 0)), ({"highway": "unknown"}, (None, 0)),
    ],
)
def test_car(spark, tags, want):
    df = spark.createDataFrame([(tags,)], "tags map<string,string>")
    car = vehicle.PROFILES["car"]
    r = df.select(vehicle.factors(F.col("tags"), car)["fastest"].alias("f"), vehicle.direction(F.col("tags"), car).alias("d")).first()
    assert r.d == want[1] and (r.f is None if want[0] is None else abs(r.f - want[0]) < 1e-12)


@pytest.mark.parametrize(("name", "tags", "speed", "direction"), [
    ("moped", {"highway": "primary", "maxspeed": "200"}, 30.0, 0), ("moped", {"highway": "primary", "maxspeed": "20"}, 15.0, 0), ("bicycle", {"highway": "footway"}, None, 0),
    ("bicycle", {"highway": "footway", "bicycle": "yes"}, 15.0, 0), ("bicycle", {"highway": "primary", "oneway": "yes", "oneway:bicycle": "-1"}, 15.0, 2),
    ("bicycle", {"highway": "primary", "oneway": "yes", "oneway:bicycle": "no"}, 15.0, 1), ("bus", {"highway": "primary", "maxspeed": "200"}, 150.0, 0),
])
def test_other_vehicles(spark, name, tags, speed, direction):
    df, p = spark.createDataFrame([(tags,)], "tags map<string,string>"), vehicle.PROFILES[name]
    assert df.select(vehicle.speed(F.col("tags"), p), vehicle.direction(F.col("tags"), p)).first() == (speed, direction)


def test_word_forms_in_titles_and_queries(spark):
    index = search.postings(spark.createDataFrame([(1, "г. Москва, улица Мира"), (2, "Москва, ул. Мира"), (3, "рп. Мира")], "id bigint, title string"), "id", ["title"])
    found = lambda q: sorted(r.doc_id for r in search.match(index, q).collect())
    assert found("ул. мира") == found("улица Мира") == [1, 2] and found("рабочий поселок") == [3] and found("г. москва, ул. мира") == [1]


def test_postcode_of_the_nearest_ancestor(spark):
    from terrane.plans import registry

    rows = [("a", None, "A", None, 0), ("h", "a", "H", "101", 1), ("w", "h", "W", "", 1), ("r", "w", "R", "", 2), ("q", "w", "Q", "202", 2), ("o", "h", "O", None, 0), ("x", "a", "X", "", 1)]
    levels = [spark.createDataFrame(rows, "guid string, parent string, title string, postcode string, building int")]
    got = {r.guid: r.title for r in registry.documents(levels).collect()}
    assert got == {"a": "A", "h": "101, A, H", "w": "101, A, H, W", "r": "101, A, H, W, R", "q": "202, A, H, W, Q", "o": "A, H, O", "x": "A, X"}


def test_a_lost_snapshot_is_an_error(spark, tmp_path):
    from pyspark.errors import AnalysisException

    from terrane.streaming import jobs

    assert jobs.snapshot(spark, str(tmp_path), -1) is None
    with pytest.raises(AnalysisException):
        jobs.snapshot(spark, str(tmp_path), 4)


def diamond(spark):
    edges = spark.createDataFrame([(1, 1, 2, 1.0), (2, 2, 4, 1.0), (3, 1, 3, 2.0), (4, 3, 4, 2.0), (5, 4, 5, 1.0)], "edge bigint, a bigint, b bigint, w double")
    nodes = spark.createDataFrame([(i, 0.0, i * 1e-6) for i in range(1, 7)], "node bigint, lat double, lon double")
    return edges, nodes, spark.createDataFrame([(1, 1, 5), (2, 5, 1), (3, 2, 2)], "query bigint, source bigint, target bigint")


@pytest.mark.parametrize("method", sorted(routing.METHODS))
def test_paths_agree_and_obey_restrictions(spark, method):
    edges, nodes, q = diamond(spark)
    got = {r.query: (r.cost, r.path) for r in routing.shortest_paths(q, edges, nodes, method=method, factor=0.001).collect()}
    assert got[1] == (3.0, [1, 2, 5]) and got[2] == (None, []) and got[3][0] == 0.0
    barred = spark.createDataFrame([(1, 2, 2)], "from_edge bigint, to_edge bigint, via_node bigint")
    got = {r.query: (r.cost, r.path) for r in routing.shortest_paths(q.where("query = 1"), edges, nodes, barred, method=method).collect()}
    assert got[1] == (5.0, [3, 4, 5])


def test_graph_build(spark):
    nodes = spark.createDataFrame([(i, 0.0, i * 0.001, {"barrier": "gate"} if i == 3 else {}) for i in range(1, 7)], "id bigint, lat double, lon double, tags map<string,string>")
    ways = spark.createDataFrame([(10, [1, 2, 3, 4]), (11, [5, 2, 6]), (12, [1, 99, 6])], "id bigint, nodes array<bigint>")
    core = graph.core_nodes(ways)
    assert {r.node for r in core.collect()} == {1, 2, 4, 5, 6}
    edges = {(r.way, r.from_node, r.to_node): r.distance for r in graph.build_edges(ways, nodes, core).collect()}
    assert set(edges) == {(10, 1, 2), (10, 2, 4), (11, 5, 2), (11, 2, 6)} and abs(edges[(10, 2, 4)] - 222.39) < 0.1
    assert {(r.a, r.b) for r in graph.shared_node_pairs(ways).collect()} == {(10, 11), (10, 12), (11, 12)}
    assert [(r.from_way, r.via_node) for r in graph.barrier_restrictions(nodes, ways).collect()] == [(10, 3)]
    rel = spark.createDataFrame([(1, {"restriction": "no_left_turn"}, [(10, "from", 1), (2, "via", 0), (11, "to", 1)])], "id bigint, tags map<string,string>, members array<struct<id:bigint,role:string,type:int>>")
    assert [tuple(r) for r in graph.relation_restrictions(rel).collect()] == [("motorcar", "no_left_turn", 10, 11, 2)]


@pytest.mark.parametrize("chains, want", [([[1, 2, 3], [3, 4, 1]], {frozenset((1, 2, 3, 4))}), ([[1, 2], [3, 2], [3, 1]], {frozenset((1, 2, 3))}), ([[5, 6, 7]], {frozenset((5, 6, 7))}), ([], set())])
def test_rings(chains, want):
    rings = places.connect_rings(chains)
    assert {frozenset(r) for r in rings} == want and all(r[0] == r[-1] for r in rings)


def test_places_and_enrichment(spark):
    nodes = spark.createDataFrame([(i, float(y), float(x), {}) for i, y, x in ((1, 0, 0), (2, 0, 10), (3, 10, 10), (4, 10, 0))] + [(9, 5.0, 5.0, {"addr:housenumber": "7"})], "id bigint, lat double, lon double, tags map<string,string>")
    ways = spark.createDataFrame([(1, [1, 2, 3], {}), (2, [3, 4, 1], {}), (3, [1, 2, 77], {"building": "yes"}), (4, [88], {"building": "yes"})], "id bigint, nodes array<bigint>, tags map<string,string>")
    rel = spark.createDataFrame([(5, {"place": "city", "name": "Tver"}, [(1, "outer", 1), (2, "outer", 1), (3, "", 1)])], "id bigint, tags map<string,string>, members array<struct<id:bigint,role:string,type:int>>")
    city = places.relation_places(rel, ways, nodes, ["place"])
    assert len(city.first().rings[0]) == 5
    assert [(r.id, r.kind) for r in places.way_places(ways, nodes, ["building"]).collect()] == [(3, "line")]
    every = places.node_places(nodes, ["addr:housenumber"]).unionByName(city)
    got = {r.id: r.tags for r in places.enrich(every, {"place=city": "addr:city"}).collect()}
    assert got[9] == {"addr:city": "Tver", "addr:housenumber": "7"}


def test_render(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (0.0, 1.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (1.0, 1.0)],)], "p array<struct<lat:double,lon:double>>")
    r = df.select(render.hull("p").alias("h"), render.simplify(1000.0)("p").alias("s"), render.unpack(render.pack(F.lit("ж"))).alias("u"), render.geojson_line(F.col("p"), F.struct(F.lit(1).alias("n"))).alias("g")).first()
    assert len(r.h) == 5 and len(r.s) == 5 and r.u == "ж" and r.g.startswith('{"type":"Feature","properties":{"n":1},"geometry":{"type":"LineString"')
    e = spark.createDataFrame([(1, 0, True, [(0.0, 0.0), (0.0, 1.0)]), (1, 1, False, [(0.0, 2.0), (0.0, 1.0)])], "route int, k int, forward boolean, shape array<struct<lat:double,lon:double>>")
    assert [p.lon for p in render.route_shape(e).first().shape] == [0.0, 1.0, 2.0]


def test_dbf_zip(spark, tmp_path):
    fields = [(b"AOID", b"C", 4, 0), (b"AOLEVEL", b"N", 3, 0), (b"NAME", b"C", 8, 0)]
    head = struct.pack("<BBBBIHH20x", 3, 24, 1, 1, 3, 32 + 32 * 3 + 1, 16) + b"".join(n.ljust(11, b"\0") + t + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, t, w, d in fields) + b"\r"
    body = b" " + b"a1  " + b"  7" + "Тверь".encode("cp866").ljust(8) + b"*" + b"a2  " + b"  1" + b"gone    " + b" " + b"a3  " + b"   " + b"        "
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("ADDROB77.DBF", head + body)
        z.writestr("README.TXT", "x")
    df = registry_files.read_dbf_zip(spark, str(tmp_path / "f.zip"), "addrob")
    assert [tuple(map(str, r)) for r in df.orderBy("aoid").collect()] == [("77", "a1", "7", "Тверь"), ("77", "a3", "None", "None")]
    assert registry_files.xml_table("77/AS_HOUSES_PARAMS_20240101_ab-12.XML") == ("AS_PARAM", "77") and registry_files.xml_table("x.txt") is None


def test_xml_table(spark, tmp_path):
    (tmp_path / "AS_HOUSES_20240101_ab-1.XML").write_text('<HOUSES><HOUSE ID="1" HOUSENUM="5"/><HOUSE ID="2"/></HOUSES>')
    df = registry_files.read_xml_table(spark, str(tmp_path), "HOUSE", "ID bigint, HOUSENUM string")
    assert sorted((r.ID, r.HOUSENUM) for r in df.collect()) == [(1, "5"), (2, None)]


def _varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _zig(n):
    return _varint(n << 1 if n >= 0 else (-n << 1) - 1)


def _field(k, value):
    return _varint(k << 3) + _varint(value) if isinstance(value, int) else _varint(k << 3 | 2) + _varint(len(value)) + value


def test_osm_pbf(spark, tmp_path):
    strings = b"".join(_field(1, s) for s in (b"", b"name", b"Tver", b"outer"))
    dense = _field(1, _zig(5) + _zig(2)) + _field(8, _zig(10**7) + _zig(-(10**7))) + _field(9, _zig(0) + _zig(3 * 10**7)) + _field(10, _varint(1) + _varint(2) + _varint(0) + _varint(0))
    way = _field(1, 70) + _field(2, _varint(1)) + _field(3, _varint(2)) + _field(8, _zig(5) + _zig(2))
    rel = _field(1, 80) + _field(8, _varint(3)) + _field(9, _zig(70)) + _field(10, _varint(1))
    block = _field(1, strings) + _field(2, _field(2, dense)) + _field(2, _field(3, way)) + _field(2, _field(4, rel))
    blob = _field(2, len(block)) + _field(3, zlib.compress(block))
    with open(tmp_path / "x.pbf", "wb") as f:
        for kind, data in ((b"OSMHeader", _field(1, b"")), (b"OSMData", blob)):
            header = _field(1, kind) + _field(3, len(data))
            f.write(struct.pack(">I", len(header)) + header + data)
    rows = osm_pbf.read_osm_pbf(spark, str(tmp_path / "x.pbf")).collect()
    assert [(r.type, r.id) for r in rows] == [("node", 5), ("node", 7), ("way", 70), ("relation", 80)]
    assert (rows[0].lat, rows[0].tags, rows[1].lat, rows[1].lon, rows[2].nodes, rows[3].members[0].role) == (1.0, {"name": "Tver"}, 0.0, 3.0, [5, 7], "outer")


def test_incremental_equals_rebuild(spark, tmp_path):
    schema = "k int, v string, n int"
    first, second = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema), spark.createDataFrame([(2, "c", 2), (3, "d", 2)], schema)
    for k, df in enumerate((first, second)):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        work = jobs.upsert_into(str(tmp_path / "out"), ["k"], "n")
        jobs.run_once(jobs.new_rows(spark, str(tmp_path / "in"), schema), work, str(tmp_path / "cp")).awaitTermination()
        got = sorted(map(tuple, jobs.snapshot(spark, str(tmp_path / "out"), k).collect()))
    assert got == sorted(map(tuple, changes.latest_wins(first, second, ["k"], "n").collect()))


def test_registry_documents(spark):
    from terrane.plans import registry

    addrob = spark.createDataFrame([("r", None, "Тверская", "Тверская", "обл", 1, 1), ("c", "r", "Тверь", "", "г", 4, 1), ("s", "c", "Мира", "Мира", "ул", 7, 1), ("old", "c", "x", "x", "ул", 7, 0)], "aoguid string, parentguid string, offname string, formalname string, shortname string, aolevel int, livestatus int")
    socrbase = spark.createDataFrame([("обл", 1, "область"), ("г", 4, "город"), ("ул", 7, "улица")], "scname string, level int, socrname string")
    house = spark.createDataFrame([("h", "s", "5", None, "2", 1, "170000", "2000-01-01", "2079-01-01"), ("dead", "s", "6", None, None, 1, None, "2000-01-01", "2001-01-01")], "houseguid string, aoguid string, housenum string, buildnum string, strucnum string, eststatus int, postalcode string, startdate string, enddate string")
    house = house.withColumns({c: F.col(c).cast("timestamp") for c in ("startdate", "enddate")})
    room = spark.createDataFrame([("f", "h", "7", None, 1, None), ("g", "h", "8", None, 0, None)], "roomguid string, houseguid string, flatnumber string, roomnumber string, livestatus int, postalcode string")
    stead = spark.createDataFrame([("p", "s", "3", 1)], "steadguid string, parentguid string, number string, livestatus int")
    levels = [registry.fias_objects(addrob, socrbase), registry.fias_houses(house, spark.createDataFrame([(1, "дом")], "eststatid int, name string"), F.lit("2024-01-01").cast("timestamp")), registry.fias_rooms(room), registry.fias_steads(stead)]
    got = {r.guid: (r.title, r.priority, r.building) for r in registry.documents(levels).collect()}
    base = "Тверская, город Тверь, улица Мира"
    assert got == {
        "r": ("Тверская", 1, 0), "c": ("Тверская, город Тверь", 2, 0), "s": (base, 3, 0), "p": (base + ", уч. 3", 4, 1),
        "h": ("170000, " + base + ", дом 5 с2", 5, 1), "f": ("170000, " + base + ", дом 5 с2, Квартира 7", 6, 2),
    }


def test_gar_levels_join_text_ids_and_skip_history(spark):
    from terrane.plans import registry

    rows = spark.createDataFrame([("1", "Мира", 1, 1), ("1", "Ленина", 0, 0), ("2", "5", 1, 1)], "OBJECTID string, NAME string, ISACTUAL int, ISACTIVE int")
    links = spark.createDataFrame([(2, 1, 1), (2, 9, 0)], "OBJECTID bigint, PARENTOBJID bigint, ISACTIVE int")
    got = {r.guid: r.title for r in registry.documents([registry.gar_level(rows, links, F.col("NAME"), 0)]).collect()}
    assert got == {"1": "Мира", "2": "Мира, 5"}


def test_search_sees_every_place_of_a_word(spark):
    rows = [(1, "Moscow region, x, Moscow, Arbat"), (2, "Moscow, x, y, Arbat"), (3, "Arbat, x, y, Moscow, x, Arbat, Moscow"), (4, "Arbat, Moscow"), (5, "Moscow"), (6, "Arbat, Moscow, x, y, z, Arbat")]
    index = search.postings(spark.createDataFrame(rows, "id bigint, title string"), "id", ["title"])
    found = lambda q: sorted(r.doc_id for r in search.match(index, q).collect())
    assert found("moscow arbat") == [1, 3, 4, 6]
    assert found("moscow, arbat") == [1, 2, 3, 6] and found("moscow arbat, arbat") == [6]


def test_shortest_paths_leave_the_box_of_their_ends(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 1.0), (3, 9.0, 0.5), (4, 50.0, 50.0)], "node bigint, lat double, lon double")
    edges = spark.createDataFrame([(10, 1, 2, 9.0), (11, 1, 3, 1.0), (12, 3, 2, 1.0)], "edge bigint, a bigint, b bigint, w double")
    queries = spark.createDataFrame([(1, 1, 2), (2, 4, 1)], "query bigint, source bigint, target bigint")
    got = {r.query: (r.cost, list(r.path)) for r in routing.shortest_paths(queries, edges, nodes).collect()}
    assert got[1] == (2.0, [11, 12]) and (got[2][0] is None or got[2][0] != got[2][0]) and got[2][1] == []
