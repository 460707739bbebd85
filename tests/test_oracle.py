"""Every registered query against its DuckDB statement on the smallest data set."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from oracle import statements
from wayfare import catalogue
from wayfare.operators import skew
from wayfare.sources.raw import from_benchmark
from wayfare.sources.warehouse import Warehouse

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("customer", "supplier", "part", "orders", "lineitem", "events")
SPARK_TO_DUCKDB = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}

# the text operators have their tests beside them
NAMES = sorted(catalogue.queries())

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="benchmark tables not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


def test_every_query_has_a_statement():
    assert set(NAMES) == set(statements())
    assert set(NAMES) <= set(entry_module.queries())


def assert_same(df, duck, name, statement=None):
    columns = sorted(df.columns)
    result = duck.execute(statement or entry_module.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in result.description}
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert {f.name: SPARK_TO_DUCKDB[f.dataType.simpleString()] for f in df.schema.fields} == kinds

    def key(row):
        return tuple(repr(v) for v in row)

    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    want = sorted(
        (tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=key
    )
    assert got == want


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    assert_same(entry_module.queries()[name](spark, SF_DIR), duck, name)


def test_same_rows_with_every_lookup_salted(spark, duck, monkeypatch):
    """No broadcast, and every key above a fifth of a percent treated as hot."""
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(skew, "HOT_SHARE", 500)
    wh = Warehouse.scratch(spark, from_benchmark(spark, SF_DIR))
    for name in (
        "customer_crosswalk", "bookings_canonical", "events_identified", "bookings_filtered",
        "terminated_provider_risk", "dq_duplicate_bookings", "conversion_net", "repeat_global",
    ):
        assert_same(catalogue.queries()[name](wh), duck, name)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
