"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest
from conftest import SF

from vantage import registry
from vantage.plans.catalog import CATALOG


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def cell(x) -> str:
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return f"{round(float(x), 5):g}"
    return str(x)


SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.mark.parametrize("key", sorted(SQL))
def test_against_sql(key, spark, duck):
    mine = QUERIES[key](spark, SF)
    theirs = duck.sql(SQL[key])
    names = sorted(theirs.columns)
    assert sorted(mine.columns) == names
    at = [theirs.columns.index(n) for n in names]
    a = sorted(tuple(map(cell, r)) for r in mine.select(*names).collect())
    b = sorted(tuple(cell(r[i]) for i in at) for r in theirs.fetchall())
    assert a == b


def test_most_queries_have_sql():
    assert len(SQL) > 0.95 * len(CATALOG)
