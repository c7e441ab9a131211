from pyspark.sql import functions as F

from terrane.functions import geo, tags, text, units


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_units(spark):
    rows = [("50", 50.0), ("50 km/h", 50.0), ("30 mph", 48.2802), ("10 knots", 18.52), ("50,5", 50.5), ("fast", None)]
    df = spark.createDataFrame(rows, "c string, want double").withColumn("got", units.speed_kmh(F.col("c")))
    assert all(r.got == r.want or abs(r.got - r.want) < 1e-9 for r in df.collect())
    assert one(spark, units.weight_kg(F.lit("3.5 t"))) == (3500.0,)
    assert one(spark, units.length_m(F.lit("2 m")), F.round(units.length_m(F.lit("6'7\"")), 4)) == (2.0, 2.0066)


def test_text(spark):
    assert one(spark, text.natural_key(F.lit("дом 12 к 3"))) == ("дом 000000000012 к 000000000003",)
    assert one(spark, text.fold_yo(F.lit("Ёлка ещё")), text.slug(F.lit("Ул. Мира, 5"))) == ("Елка еще", "улмира5")
    assert one(spark, text.house_title(F.lit("дом"), F.lit("5"), F.lit(""), F.lit("2"))) == ("дом 5 с2",)
    assert one(spark, text.room_title(F.lit("7"), F.lit("2")), text.stead_title(F.lit("3"))) == ("Квартира 7, Комната 2", "уч. 3")
    assert one(spark, text.replace_words(F.lit("ул. Мира"), text.WORDFORMS)) == ("улица мира",)
    assert one(spark, text.with_postcode(True, F.lit(""), F.lit("101000"), F.lit("Москва")), text.with_postcode(False, F.lit("1"), F.lit("2"), F.lit("x"))) == ("101000, Москва", "x")
    assert one(spark, F.lit("Lenina st").rlike(text.similar_to("Len_na%")), F.lit("x Lenina").rlike(text.similar_to("Lenina"))) == (True, False)


def test_tags(spark):
    bag = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None).cast("string"))
    assert one(spark, tags.has_key(bag, "b"), tags.get(bag, "b"), tags.has_any_key(bag, ["x", "a"]), tags.last_index_present(bag, ["a", "x", "b", "y"])) == (True, None, True, 3)
    assert one(spark, tags.name_or_ref(F.create_map(F.lit("ref"), F.lit("M1"))), tags.is_true(F.lit("Yes")), tags.is_false(F.lit("x"))) == ("M1", True, False)
    same = tags.same_tags(F.create_map(F.lit("a"), F.lit("1"), F.lit("t"), F.lit("x")), F.create_map(F.lit("t"), F.lit("y"), F.lit("a"), F.lit("1")), ("t",))
    assert one(spark, same) == (True,)


def test_merge_maps_prefers_rank_then_value(spark):
    df = spark.createDataFrame([(1, "city", "b", 1, 5.0), (1, "city", "a", 1, 2.0), (1, "city", "own", 0, 0.0), (1, "x", "z", 1, 1.0), (1, "x", "y", 1, 1.0)], "id int, key string, value string, rank int, size double")
    assert tags.merge_maps(df, ["id"], "key", "value", ["rank", "size"]).first().tags == {"city": "own", "x": "y"}


def test_geo(spark):
    lit = F.lit
    assert one(spark, F.round(geo.haversine(lit(0.0), lit(0.0), lit(0.0), lit(1.0)))) == (111195.0,)
    assert one(spark, F.round(geo.angle(lit(0.0), lit(1.0), lit(0.0), lit(0.0), lit(1.0), lit(0.0)), 6), geo.angle(lit(0.0), lit(0.0), lit(0.0), lit(0.0), lit(1.0), lit(0.0))) == (90.0, 180.0)
    p = one(spark, geo.closest_on_segment(lit(1.0), lit(0.5), lit(0.0), lit(0.0), lit(0.0), lit(1.0)).alias("p")).p
    assert (p.lat, p.lon, p.t) == (0.0, 0.5, 0.5)
    assert one(spark, geo.parse_point(lit("55.5,37.25")).alias("p")).p.lon == 37.25
    lat, lon = geo.offset(lit(10.0), lit(20.0), lit(1000.0), lit(45.0))
    assert abs(one(spark, geo.haversine(lit(10.0), lit(20.0), lat, lon))[0] - 1000) < 1e-6
    assert one(spark, geo.smallest_difference(lit(350.0), lit(10.0)), geo.shift_longitude(lit(-170.0)), geo.valid(lit(91.0), lit(0.0))) == (-20.0, 190.0, False)


def test_point_in_rings_with_a_hole(spark):
    square, hole = [(0.0, 0.0), (0.0, 10.0), (10.0, 10.0), (10.0, 0.0)], [(4.0, 4.0), (4.0, 6.0), (6.0, 6.0), (6.0, 4.0)]
    df = spark.createDataFrame([([square, hole], 1.0, 1.0), ([square, hole], 5.0, 5.0), ([square, hole], 11.0, 5.0)], "rings array<array<struct<lat:double,lon:double>>>, lat double, lon double")
    assert [r[0] for r in df.select(geo.in_rings(F.col("lat"), F.col("lon"), F.col("rings"))).collect()] == [True, False, False]
    assert [r[0] for r in df.select(geo.in_ring(F.col("lat"), F.col("lon"), square)).collect()] == [True, True, False]
    assert abs(df.select(geo.ring_area(F.col("rings")[0])).first()[0]) == 100.0
