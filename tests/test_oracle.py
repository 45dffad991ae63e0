"""Every registered query of the racing domain against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from stintline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    value = value.item() if hasattr(value, "item") else value
    return None if isinstance(value, float) and value != value else value


def test_same_names():
    assert catalog.queries().keys() == catalog.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    answer = duck.sql(catalog.oracle_sql()[name])
    assert columns == sorted(answer.columns)
    want = sorted(repr([plain(dict(zip(answer.columns, r))[c]) for c in columns]) for r in answer.fetchall())
    assert got == want


def test_flagship(spark):
    rows = catalog.flagship(spark, SF).collect()
    assert rows and abs(sum(r.win_prob for r in rows) - 1) < 1e-6
