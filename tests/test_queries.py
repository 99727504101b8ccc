"""Every registered query against its DuckDB SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from maskwright.plans import registry

DATA = "/root/testdata/sf0.001"


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows(columns, data):
    return sorted(tuple(plain(r[c]) for c in columns) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    data = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert rows(columns, [r.asDict() for r in got.collect()]) == rows(columns, data)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.ORACLES) <= set(registry.QUERIES) <= set(entry.queries())
