"""The corpus queries that have SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from tempora import queries as own

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.mark.parametrize("name", sorted(set(driver.oracle_sql()) - set(own.oracle_sql())))
def test_corpus_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = driver.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(driver.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    rows = lambda found: sorted((tuple(r) for r in found), key=repr)
    assert rows(df.select(*columns).collect()) == rows(tuple(r[i] for i in at) for r in want.fetchall())
