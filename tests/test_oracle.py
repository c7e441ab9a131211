"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from terrane import queries as engine

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted([tuple(None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False)], key=repr)


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    got, want = engine.QUERIES[name](spark, SF).toPandas(), duck.execute(engine.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert [tuple(map(str, r)) for r in rows(got)] == [tuple(map(str, r)) for r in rows(want)]


@pytest.mark.parametrize("name", sorted(set(engine.QUERIES) - set(engine.ORACLE_SQL)))
def test_runs(spark, name):
    assert engine.QUERIES[name](spark, SF).count() > 0


def test_packing_of_titles_round_trips(spark):
    assert engine.QUERIES["packed_titles"](spark, SF).where("not same").count() == 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
