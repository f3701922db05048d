"""Every registered query equals its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of
from servemetry.plans.catalog import QUERIES

from .conftest import SMALL

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SMALL)
    twin = con.execute(ORACLES[name])
    columns = [c[0] for c in twin.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, twin.fetchall())


def test_flagship_has_a_stable_schema(spark):
    assert entry.entry(spark).columns[:4] == ["run", "class", "concurrency", "thinking"]
