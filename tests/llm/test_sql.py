"""Queries that SQL can express, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from stintline.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    answer = con.sql(catalog.oracle_sql()[name])
    df = catalog.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(answer.columns)
    columns = answer.columns
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == sorted(str(list(r)) for r in answer.fetchall())
