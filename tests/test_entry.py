"""The registry: every SQL has its query, and every query with SQL agrees with DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from oriel.plans import queries as plans

SF = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.oracle_sql()) <= set(plans.queries())


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_agrees_with_duckdb(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    show = lambda v: f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)  # noqa: E731  (no minus zero)
    got = sorted([show(r[c]) for c in cols] for r in df.collect())
    want = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({plans.oracle_sql()[name]})").fetchall()
    assert got == sorted([show(v) for v in r] for r in want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_queries_without_sql_give_rows(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).columns == ["s_suppkey", "status", "entity_id", "confidence", "output", "n_rows", "revenue"]
