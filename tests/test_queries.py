"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from lectern import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    if sql := catalog.oracle_sql().get(name):
        found = duck.execute(sql)
        order = [x[0] for x in found.description]
        assert sorted(order) == names
        assert rows == sorted(repr([plain(r[order.index(c)]) for c in names]) for r in found.fetchall())
    else:
        assert rows


def test_entry(spark):
    assert catalog.flagship(spark, SF).count() > 0
