"""The corpus queries that have SQL, against it on the given tables."""

import os

import duckdb
import pytest

from hindsight.llm import queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')")
    result = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    expected = sorted(map(str, result.fetchall()))
    df = queries.queries()[name](spark, SF_DIR).select(*columns)
    assert sorted(str(tuple(r)) for r in df.collect()) == expected
    assert expected and set(columns) == set(queries.queries()[name](spark, SF_DIR).columns)
