"""Every registered query against its SQL on the given tables."""

import os

import duckdb
import pytest

import __spark_entry__ as spark_entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("events", "orders", "lineitem")


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_DIR}/{name}.parquet')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(
        (tuple(row[i] for i in order) for row in rows), key=lambda row: [(v is None, str(v)) for v in row]
    )


def test_every_query_has_an_oracle():
    assert {q.__name__ for q in spark_entry.LIBRARY} <= set(spark_entry.oracle_sql())
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


@pytest.mark.parametrize("name", [q.__name__ for q in spark_entry.LIBRARY])
def test_query_matches_oracle(spark, connection, name):
    df = spark_entry.queries()[name](spark, SF_DIR)
    result = connection.execute(spark_entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, df.collect()) == _rows(columns, expected)
    assert expected
