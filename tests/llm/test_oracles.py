"""The operators that SQL can express give DuckDB's rows."""

from __future__ import annotations

import os

import duckdb
import pytest

from corpusframe.llm.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = c.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    rows = sorted(tuple(str(r[k]) for k in columns) for r in df.collect())
    assert rows == sorted(tuple(str(r[want.columns.index(k)]) for k in columns) for r in want.fetchall())
