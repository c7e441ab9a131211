"""Tables kept in place: touched buckets alone are rewritten, results equal a rebuild, lost buckets are errors."""

import glob
import os
import shutil

import pytest
from pyspark.errors import AnalysisException

from terrane.plans import search
from terrane.streaming import jobs
from terrane.streaming.kept import KeptTable, SearchIndex, merge_into


def files(folder):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{folder}/g-*/*/*.parquet")}


def test_a_batch_rewrites_its_buckets_and_equals_a_rebuild(spark, tmp_path):
    one, two = KeptTable(spark, f"{tmp_path}/a", ["k"], 40), KeptTable(spark, f"{tmp_path}/b", ["k"], 40)
    assert one.read() is None
    base = spark.range(4000).selectExpr("id as k", "id * 2 as v")
    one.rebuild(base)
    before = files(f"{tmp_path}/a")
    batch = spark.createDataFrame([(k, -k) for k in (5, 77, 3999, 4000)], "k bigint, v bigint")
    touched = one.merge(batch)
    same = {p for p, t in files(f"{tmp_path}/a").items() if before.get(p) == t}
    assert 1 <= len(touched) <= 4 and len({os.path.dirname(p) for p in same}) == 40 - len(touched)
    two.rebuild(base.join(batch, "k", "left_anti").unionByName(batch))
    rows = lambda t: sorted(map(tuple, t.read().collect()))
    assert rows(one) == rows(two) and one.merge(batch) == touched and rows(one) == rows(two)
    assert one.merge(batch.limit(0)) == []
    one.rebuild(batch)
    assert len(rows(one)) == 4 and len(glob.glob(f"{tmp_path}/a/g-*")) == 1


def test_versions_new_buckets_and_lost_ones(spark, tmp_path):
    t = KeptTable(spark, f"{tmp_path}/t", ["k"], 1000, version="n")
    t.merge(spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "x")], "k int, n int, v string"))
    assert sorted(map(tuple, t.read().collect())) == [(1, 3, "c"), (2, 1, "x")]
    t.merge(spark.createDataFrame([(k, 9, "new") for k in range(2, 30)], "k int, n int, v string"))
    assert t.read().count() == 29 and t.read().where("v = 'x'").count() == 0
    shutil.rmtree(sorted(glob.glob(f"{tmp_path}/t/g-*/*"))[3])
    with pytest.raises(AnalysisException):
        t.read().collect()


def test_a_stream_merges_what_is_new(spark, tmp_path):
    t, source = KeptTable(spark, f"{tmp_path}/t", ["k"], 8), f"{tmp_path}/in"
    for rows in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]):
        spark.createDataFrame(rows, "k int, v string").write.mode("append").parquet(source)
        jobs.run_once(jobs.new_rows(spark, source, "k int, v string"), merge_into(t), f"{tmp_path}/progress").awaitTermination()
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_search_index_replaces_documents(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path), "id", ["title"], 8)
    docs = lambda rows: spark.createDataFrame(rows, "id int, title string")
    index.rebuild(docs([(1, "Москва, Арбат"), (2, "Тверь, Мира"), (3, "Москва")]))
    find = lambda q: sorted(r.doc_id for r in search.match(index.postings(), q).collect())
    assert find("москва") == [1, 3]
    index.merge(docs([(3, "Казань"), (2, None), (4, "Москва, Мира")]))
    assert find("москва") == [1, 4] and find("мира") == [4] and find("каз") == [3] and index.docs.read().count() == 4
