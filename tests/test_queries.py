"""Every registered query against its SQL, and the shape of its plan."""

import math

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from tallyfold.checks import QUERIES, SQL
from tallyfold.sources.domain import BASE_TABLES

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroups"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value.item() if hasattr(value, "item") else value


def result(frame, columns):
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [op for op in FORBIDDEN if op in plan]
    columns = sorted(df.columns)
    expected = duck.sql(SQL[name]).df()
    assert sorted(expected.columns) == columns
    assert result(df.toPandas(), columns) == result(expected, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
