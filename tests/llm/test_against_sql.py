"""The operators that SQL can express, against DuckDB on the smallest test tables."""

import os

import pytest

from chimerascope.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    out = queries.queries()[name](spark, FOLDER)
    assert sorted(out.columns) == columns
    assert sorted(map(str, (tuple(r) for r in out.select(*columns).collect()))) == sorted(map(str, want.select(", ".join(columns)).fetchall()))
