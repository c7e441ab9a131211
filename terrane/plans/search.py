"""Address search: documents to postings, prefix and order matching, attribute filters, deduplicated top-k."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, tags as t
from ..functions.stems import stem_ru
from ..functions.text import WORDFORMS, fold_yo, replace_words

#: Positions that a comma adds, so parts of an address stay apart.
COMMA_STEP = 100
#: Characters of the longest gram.
GRAM = 3
SAFE_KEY = re.compile(r"^[A-Za-z0-9.:_`]+$")


def normalise(c, wordforms: dict[str, str] | None = WORDFORMS) -> Column:
    c = F.lower(fold_yo(c))
    return fold_yo(replace_words(F.trim(c), wordforms)) if wordforms else c


def postings(docs: DataFrame, id_col: str, fields: list[str], wordforms: dict[str, str] | None = WORDFORMS, stems: bool = False) -> DataFrame:
    """(doc_id, field, pos, term): terms are runs of letters, digits and - in order; a comma moves positions on by 100.

    Runs with . + & inside (which blend) are terms as a whole, & as +, at the place of their first piece.
    Short forms of address words stand as their full forms, in the index as in queries. With
    stems, terms are the stems of Russian words.

    Meant to be written bucketed or sorted by term, so a prefix reads few files.
    """

    def placed(parts):
        """(pos, term) of all words of a text's parts, in one pass."""
        none = F.array().cast("array<struct<pos:bigint,term:string>>")

        def word(acc, w):
            pieces = F.filter(F.split(w, "[.+&]+"), lambda x: x != "")
            own = F.transform(pieces, lambda x, k: F.struct((acc["at"] + k).alias("pos"), x.alias("term")))
            whole = F.when(w.rlike("[.+&]") & (F.size(pieces) > 0), F.array(F.struct(acc["at"].alias("pos"), F.translate(w, "&", "+").alias("term")))).otherwise(none)
            return F.struct(F.concat(acc["out"], own, whole).alias("out"), (acc["at"] + F.size(pieces)).alias("at"))

        part = lambda acc, p: F.aggregate(p, F.struct(none.alias("out"), acc["at"].alias("at")), word)
        one = lambda acc, p: F.transform(F.array(part(acc, p)), lambda r: F.struct(F.concat(acc["out"], r["out"]).alias("out"), (r["at"] + COMMA_STEP).alias("at")))[0]
        return F.aggregate(parts, F.struct(none.alias("out"), F.lit(0).cast("bigint").alias("at")), one)["out"]

    out = []
    for f in fields:
        runs = lambda p: F.filter(F.split(normalise(p, wordforms), r"[^\p{L}\p{N}.+&-]+"), lambda x: x != "")
        words = docs.select(F.col(id_col).alias("doc_id"), F.explode(placed(F.transform(F.split(F.col(f), ","), runs))).alias("w"))
        out.append(words.select("doc_id", F.lit(f).alias("field"), F.col("w.pos").alias("pos"), (stem_ru(F.col("w.term")) if stems else F.col("w.term")).alias("term")))
    return reduce(DataFrame.unionByName, out)


def grams(index: DataFrame) -> DataFrame:
    """(gram, term): each distinct term under its runs of one to three characters. Meant to be written next to the index, sorted by gram."""
    starts = F.sequence(F.lit(1), F.length("term"))
    runs = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(F.substring("term", i, F.lit(1)), F.substring("term", i, F.lit(2)), F.substring("term", i, F.lit(GRAM))))))
    return index.select("term").where("term <> ''").distinct().select(F.explode(runs).alias("gram"), "term")


def _with_infixes(words: list[str], gram_index: DataFrame) -> DataFrame:
    """(k, term): terms with the k-th word inside, by the postings of the word's own grams and then by the word itself."""
    asked = [(k, w, g, len(set(gs))) for k, w in enumerate(words) for gs in [[w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))]] for g in sorted(set(gs))]
    q = F.broadcast(gram_index.sparkSession.createDataFrame(asked, "k int, word string, gram string, n int"))  # the words of one query
    met = gram_index.where(F.col("gram").isin([g for *_, g, _ in asked])).join(q, "gram")
    return met.groupBy("k", "word", "term", "n").agg(F.count(F.lit(1)).alias("hits")).where("hits = n and contains(term, word)").select("k", "term")


def parse(query: str, wordforms: dict[str, str] | None = WORDFORMS) -> list[list[str]]:
    """Words of each non-blank comma part, lower-cased, short forms in full, stars trimmed."""
    full = lambda w: (wordforms or {}).get(w, w).replace("ё", "е").split()
    parts = [[w.strip("*").replace("&", "+") for short in p.lower().replace("ё", "е").split() for w in full(short)] for p in (query or "").split(",")]
    return [q for q in ([w for w in p if w] for p in parts) if q]


def match(index: DataFrame, query: str, field: str | None = None, near: int = 199, mode: str = "prefix", gram_index: DataFrame | None = None) -> DataFrame:
    """(doc_id) of documents that hold every word, words of a part close together, parts in order.

    mode: a word stands for terms that begin with it (prefix), have it inside (infix, by
    gram_index), or share its stem (stem, with an index of stems).

    One aggregate over the postings that any word matches keeps all places of
    each word per document. A part's windows end at a place of one of its
    words and begin at the earliest of the other words' last places up to
    there; of the windows that begin after the part before and are narrow
    enough, the one that ends first leaves most room for the next part.
    """
    parts = parse(query)
    if not parts:
        return index.select("doc_id").limit(0)
    words = [(i, w) for i, p in enumerate(parts) for w in p]
    rows = index if field is None else index.where(F.col("field") == field)
    if mode == "prefix":
        rows = rows.where(reduce(lambda a, b: a | b, [F.col("term").startswith(w) for _, w in words]))
        hit = lambda k, w: F.when(F.col("term").startswith(w), F.col("pos"))
    else:
        if mode == "infix":
            terms = _with_infixes([w for _, w in words], gram_index)
        else:
            q = index.sparkSession.createDataFrame([(k, w) for k, (_, w) in enumerate(words)], "k int, word string")
            terms = F.broadcast(q.select("k", stem_ru(F.col("word")).alias("term")))  # the words of one query
        rows = rows.join(terms, "term")
        hit = lambda k, w: F.when(F.col("k") == k, F.col("pos"))
    by = rows.groupBy("doc_id", "field").agg(*[F.array_sort(F.collect_set(hit(k, w))).alias(f"at{k}") for k, (_, w) in enumerate(words)])
    by = by.where(reduce(lambda a, b: a & b, [F.size(f"at{k}") > 0 for k in range(len(words))])).withColumn("end", F.lit(-1).cast("bigint"))
    for i, p in enumerate(parts):
        own = [f"at{k}" for k, (j, _) in enumerate(words) if j == i]
        ends = F.array_sort(F.array_distinct(F.flatten(F.array(*own))))
        last = lambda e: [F.array_max(F.filter(c, lambda x: x <= e)) for c in own]  # noqa: B023, E731
        start = lambda e: F.least(*last(e)) if len(own) > 1 else last(e)[0]  # noqa: B023, E731
        every = lambda e: reduce(lambda a, b: a & b, [x.isNotNull() for x in last(e)])  # noqa: B023, E731
        narrow = lambda e: (e - start(e) - len(own) < near) if len(own) > 1 else F.lit(True)  # noqa: B023, E731
        fits = F.filter(ends, lambda e: every(e) & (start(e) > F.col("end")) & narrow(e))  # noqa: B023
        by = by.withColumn("end", F.array_min(fits).cast("bigint")).where("end is not null")
    return by.select("doc_id").distinct()


def attribute_filter(tags, wanted: list[dict[str, str]]) -> Column:
    """Pairs of one object all hold, of several objects any; keys that are no plain names are ignored."""
    objects = []
    for o in wanted:
        tests = [t.get(tags, k) == v for k, v in sorted(o.items()) if SAFE_KEY.match(k)]
        if tests:
            objects.append(reduce(lambda a, b: a & b, tests))
    return F.coalesce(reduce(lambda a, b: a | b, objects), F.lit(False)) if objects else F.lit(True)


def dedup_topk(df: DataFrame, title: str, order: list[str], k: int, raw: bool = False) -> DataFrame:
    """The first k rows by order, of titles that differ only in case the first; raw keeps all."""
    if not raw:
        best = df.groupBy(F.lower(title).alias("__t")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__row"))
        df = best.select("__row.*")
    return df.orderBy(*order).limit(k)


def search(docs: DataFrame, index: DataFrame, query: str, limit: int = 20, raw: bool = False, custom: bool = False, wanted: list[dict] | None = None, level: int = 0) -> DataFrame:
    """Documents of an address index that match, by priority and natural sort key."""
    field = "custom_title" if custom else "title"
    found = docs.join(match(index, query, field), docs["id"] == F.col("doc_id"), "left_semi")
    found = found.where((F.col("custom_level") >= level) & attribute_filter(F.col("data"), wanted or []))
    return dedup_topk(found, field, ["priority", "sorting", "id"], limit, raw)


def reverse_geocode(docs: DataFrame, lat: float, lon: float, limit: int = 20, raw: bool = False, wanted: list[dict] | None = None, level: int = 0) -> DataFrame:
    """The nearest documents, by metres."""
    found = docs.where((F.col("custom_level") >= level) & attribute_filter(F.col("data"), wanted or []))
    found = found.withColumn("distance", geo.haversine(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)))
    return dedup_topk(found, "title", ["distance", "id"], limit, raw)
