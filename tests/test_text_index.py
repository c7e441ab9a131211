"""Stems, infixes and positions of the text index."""

import pytest
from pyspark.sql import functions as F

from terrane.functions.stems import stem_ru
from terrane.plans import search

#: Words and stems as the public rules publish them.
STEMS = {
    "в": "в", "вавиловка": "вавиловк", "вагнера": "вагнер", "вагон": "вагон", "вагонов": "вагон", "вагоном": "вагон", "важная": "важн", "важнее": "важн", "важнейшие": "важн", "важнейшими": "важн", "важничал": "важнича", "важно": "важн", "важного": "важн", "важности": "важност",
    "важностию": "важност", "важность": "важност", "важностью": "важност", "важную": "важн", "важных": "важн", "вазах": "ваз", "вакса": "вакс", "вакханка": "вакханк", "вал": "вал", "валандался": "валанда", "валериановых": "валерианов", "валерию": "валер", "валетами": "валет", "п": "п", "па": "па", "пава": "пав",
    "street": "street", "7а": "7а", "": "",
}


def test_stems(spark):
    df = spark.createDataFrame(list(STEMS.items()), "word string, want string").withColumn("got", stem_ru(F.col("word")))
    assert {r.word: r.got for r in df.collect()} == STEMS


def index_of(spark, texts, **how):
    return search.postings(spark.createDataFrame(list(enumerate(texts)), "id int, title string"), "id", ["title"], **how)


def found(index, query, **how):
    return sorted(r.doc_id for r in search.match(index, query, **how).collect())


def test_parts_of_over_a_hundred_words_keep_their_order(spark):
    index = index_of(spark, [" ".join(f"w{k}" for k in range(1, 121)) + ", tail", "a, " + " ".join(f"x{k}" for k in range(150)) + ", b c"])
    assert found(index, "w120, tail") == [0] and found(index, "tail, w120") == []
    assert found(index, "a, x149, c") == [1] and found(index, "x149, a") == [] and found(index, "b, x149") == []
    pos = {r.term: r.pos for r in index.where("doc_id = 1").collect()}
    assert (pos["a"], pos["x0"], pos["x149"], pos["b"]) == (0, 101, 250, 351)


def test_infixes_are_found_by_grams_and_checked(spark):
    index = index_of(spark, ["Кутузовский проспект", "Кутузова улица", "abcab xbcx", None, "", "a"])
    g = search.grams(index)
    look = lambda q: found(index, q, mode="infix", gram_index=g)
    assert look("тузов") == [0, 1] and look("тузовск просп") == [0] and look("ул") == [1] and look("а") == [1] and look("a") == [2, 5]
    assert look("bcab") == [2] and look("cabc") == [] and look("bcabc") == []


def test_stemmed_search_and_blended_runs(spark):
    index = index_of(spark, ["улица Большая", "улицы Малые", "улей большой"], stems=True)
    assert found(index, "улицами", mode="stem") == [0, 1] and found(index, "больших, улице", mode="stem") == [] and found(index, "улице большую", mode="stem") == [0]
    terms = {(r.pos, r.term) for r in index_of(spark, ["at&t 5.1 v+"]).collect()}
    assert terms == {(0, "at"), (1, "t"), (0, "at+t"), (2, "5"), (3, "1"), (2, "5.1"), (4, "v"), (4, "v+")}
    assert found(index_of(spark, ["shop at&t", "shop at t"]), "at&t") == [0]


@pytest.mark.parametrize("mode", ["prefix", "infix", "stem"])
def test_empty_queries_and_tables(spark, mode):
    index = index_of(spark, ["a b"]).limit(0)
    assert found(index, " , ", mode=mode, gram_index=search.grams(index)) == [] and found(index, "a", mode=mode, gram_index=search.grams(index)) == []
