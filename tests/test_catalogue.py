"""Registered queries against their SQL in DuckDB, on the driver's smallest tables; the interface of the entry module."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__
from stratum.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(x, 6) if isinstance(x, float) and math.isfinite(x) else x for x in (r[i] for i in order)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, tables, name):
    got = catalogue.QUERIES[name](spark, SF)
    cursor = tables.execute(catalogue.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(map(tuple, got.collect()), got.columns) == plain(cursor.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_is_stable(spark, name):
    first, again = (sorted(map(repr, catalogue.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert first and first == again


def test_whole_table_queries_reach_the_head(spark):
    head = catalogue.head_block(catalogue.changes(spark, SF))
    nodes = catalogue.trie_pruned_nodes(spark, SF)
    assert nodes.agg({"last_block": "max"}).first()[0] == head // 2  # it was 4 on every table
    for name in ("merged_runs", "dense_provenance", "rebuilt_rows"):
        assert catalogue.QUERIES[name](spark, SF).agg({"block": "max"}).first()[0] == head
    assert catalogue.rewind_plan(spark, SF).agg({"block_hi": "max"}).first()[0] == head


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
