"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as driver
from tempora import queries as own

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float | decimal.Decimal):
        return float(f"{float(v):.9g}")
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = own.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(own.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = lambda found: sorted((tuple(plain(v) for v in r) for r in found), key=repr)
    assert rows(df.select(*columns).collect()) == rows(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry_is_the_flagship(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", ["dense_topk", "tri_search", "greedy_pack", "knapsack_selected", "adaptive_chunk", "grid_search"])
def test_core_queries_run_no_python(spark, name):
    plan = own.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_topk_cuts_before_the_shuffle(spark):
    plan = own.queries()["dense_topk"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
