"""Top rows per symbol: tails, last quotes, champions, requested symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.series import first_rows
from tickloom.schemas import INDEX_SYMBOL


def tail(df: DataFrame, n: int, key: str = "symbol", order: str = "date") -> DataFrame:
    """The last ``n`` rows per key."""
    return first_rows(df, key, [F.col(order).desc()], n)


def last_quote(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max_by("close", "date").alias("last_price"), F.max("date").alias("last_date"))


def champion(trials: DataFrame, metric: str = "rmse", tie: str = "trial_id") -> DataFrame:
    """The trial with the lowest metric per symbol, lowest id on ties; an aggregate, so it combines before the shuffle."""
    values = [c for c in trials.columns if c != "symbol"]
    best = trials.filter(F.col(metric).isNotNull()).groupBy("symbol")
    picked = best.agg(F.min_by(F.struct(*values), F.struct(metric, tie)).alias("_best"))
    return picked.select("symbol", "_best.*")


def without_index(df: DataFrame) -> DataFrame:
    """All symbols but the market index."""
    return df.filter(F.col("symbol") != INDEX_SYMBOL)


def symbols_without_data(requested: DataFrame, history: DataFrame) -> DataFrame:
    known = history.select("symbol").distinct()
    return requested.select("symbol").distinct().join(known, "symbol", "left_anti")
