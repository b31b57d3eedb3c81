"""Every registered query against its SQL counterpart in DuckDB, at the smallest scale."""

from __future__ import annotations

import os

import duckdb
import pytest

from graphloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are absent")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, tables, name):
    found = registry.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    cursor = tables.execute(registry.ORACLES[name])
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == columns
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    wanted = sorted((tuple(plain(dict(zip(theirs, r, strict=True))[c]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert rows == wanted


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert {"id", "depth", "first", "parent", "cause", "also"} == set(__spark_entry__.entry(spark).columns)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
