"""Every query against its SQL in DuckDB, over whole tables."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


def plain(value):
    if value is None or isinstance(value, float) and value != value:
        return "none"
    return f"{float(value):.6g}" if isinstance(value, (int, float, Decimal)) and not isinstance(value, bool) else str(value)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    rows = got.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows or not duck.sql("SELECT 1 FROM documents").fetchall()
        return
    want = duck.sql(sql)
    assert sorted(want.columns) == sorted(got.columns)
    order = sorted(got.columns)
    left = sorted(tuple(plain(r[c]) for c in order) for r in rows)
    at = [want.columns.index(c) for c in order]
    assert left == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
