"""Every query with SQL against DuckDB on the smallest tables, and the entry points."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from graindex import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    got = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(plain(v) for v in row) for row in got.fetchall())
    assert sorted(tuple(plain(r[n]) for n in names) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
