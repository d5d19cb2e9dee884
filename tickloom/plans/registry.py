"""Named queries, each with the equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.functions.scalar import rounded

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def show(df: DataFrame, *columns: str, **digits: int) -> DataFrame:
    """Select plain columns and, rounded, the columns named with their digits."""
    return df.select(*columns, *[rounded(c, d).alias(c) for c, d in digits.items()])
