"""Every query with SQL gives the same rows in DuckDB."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from corpusframe.plans.catalog import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, list | tuple | np.ndarray):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(pd.Timestamp(v)) if isinstance(v, datetime.datetime) else repr(float(v)) if isinstance(v, float | np.floating) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{FOLDER}/{f}')")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    r = duck.sql(ORACLE_SQL[name])
    assert sorted(r.columns) == columns
    assert rows == sorted(tuple(plain(x[r.columns.index(c)]) for c in columns) for x in r.fetchall())


@pytest.mark.parametrize("name", ["bm25_search", "phrase_query", "facet_counts", "rerank_boosts", "query_string", "commit_search", "snapshot_diff"])
def test_no_python_in_the_plan(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["range_filter"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "o_custkey" not in plan.split("ReadSchema")[1]
