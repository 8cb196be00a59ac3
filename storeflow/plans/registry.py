"""Registry of query plans: name -> (spark builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query builder; ``sql`` is DuckDB SQL over the driver views
    with the same column names, or None for a rows-only check."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def sql_values(values: list[str], col: str = "q") -> str:
    """A one-column VALUES list as SQL text."""
    rows = ", ".join("('" + v.replace("'", "''") + "')" for v in values)
    return f"(select * from (values {rows}) as t({col}))"
