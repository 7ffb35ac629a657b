"""Where queries and their oracle SQL are registered side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with the SQL that must give the same rows."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(value: Column) -> Column:
    """Six decimals, never a negative zero: float sums depend on their order."""
    return F.round(value, 6) + F.lit(0.0)


def sq6(expr: str) -> str:
    """r6 in SQL."""
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"
