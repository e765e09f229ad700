"""Every registered query against its SQL, on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, canonical

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == canonical(cursor.fetchall(), names)


def test_entry(spark):
    assert {r["classification"] for r in entry.entry(spark).collect()} >= {"normal", "abnormal", "unknown"}


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
