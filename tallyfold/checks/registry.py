"""Registration of queries and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyfold.sources.domain import Domain, with_tables
from tallyfold.sources.warehouse import to_warehouse_types

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, tables: list[str], sql: str | None):
    """Register ``fn(domain) -> DataFrame`` under ``name``.

    Results leave in warehouse types (money as double, dates as text), so that
    any engine prints the same values.
    """

    def register(fn: Callable[[Domain], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return to_warehouse_types(fn(Domain(spark, sf_dir)))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_tables(tables, sql)
        return fn

    return register


def num(*names: str) -> str:
    """Columns as doubles under their own name: ``num('a', 'sum(b) c')``."""
    out = []
    for item in names:
        expr, _, alias = item.rpartition(" ")
        out.append(f"cast({expr or alias} as double) as {alias}")
    return ", ".join(out)


def day(expr: str, alias: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d') as {alias or expr}"


def second(expr: str, alias: str | None = None) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') as {alias or expr}"
