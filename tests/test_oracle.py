"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from sparkloom.plans import ORACLE_SQL, QUERIES
from sparkloom.sources.tables import COLUMNS

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in COLUMNS:
        con.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(value: object) -> object:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 9)
    return value


def rows(columns: list[str], found: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_duckdb(spark, duck, name):
    mine = QUERIES[name](spark, FOLDER)
    theirs = duck.sql(ORACLE_SQL[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine.columns, [tuple(r) for r in mine.collect()]) == rows(theirs.columns, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_models_give_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
