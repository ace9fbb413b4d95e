"""Every query with a SQL counterpart returns the same rows as that SQL in DuckDB."""

import datetime
import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, float):
        return value + 0.0
    return float(value) if type(value).__name__ == "Decimal" else value


def ordered(rows, names):
    places = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(row[i]) for i in places) for row in rows), key=repr)


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_rows(spark, connection, name):
    found = contract.queries()[name](spark, DATA)
    expected = connection.execute(contract.oracle_sql()[name])
    names = [c[0] for c in expected.description]
    assert sorted(found.columns) == sorted(names)
    assert ordered(found.collect(), found.columns) == ordered(expected.fetchall(), names)
