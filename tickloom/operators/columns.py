"""Tolerant column handling: rename, drop, align, scrub, drop incomplete rows, count nulls."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import finite
from tickloom.operators.series import attach


def rename_existing(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def drop_existing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def drop_stray_index(df: DataFrame) -> DataFrame:
    """Drop columns that a CSV writer left over from an index."""
    return df.drop(*[c for c in df.columns if c.startswith("Unnamed")])


def align_zero(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Exactly ``columns`` in that order; one that is missing becomes 0."""
    return df.select(*keep, *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns])


def align_reference_mean(
    current: DataFrame, reference: DataFrame, columns: Sequence[str], key: str = "symbol"
) -> DataFrame:
    """Add each column that only ``reference`` has, filled with its mean there per key."""
    missing = [c for c in columns if c not in current.columns]
    if not missing:
        return current
    spread = [c for c in current.columns if c != key]
    means = reference.groupBy(key).agg(*[F.avg(c).alias(c) for c in missing])
    return attach(current, means, key, spread, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in missing})


def scrub(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinite, NaN and NULL values become 0."""
    return df.withColumns({c: F.coalesce(finite(c), F.lit(0.0)) for c in columns})


def complete(columns: Sequence[str]) -> Column:
    """True where none of the columns is NULL."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return ok


def keep_complete(df: DataFrame, columns: Sequence[str], target: str, training: bool, key: str = "symbol", bounded: bool = False) -> DataFrame:
    """Rows without NULL features. ``bounded`` says that a key has few rows.

    Training also needs the target.  At inference a symbol with no complete row at all
    keeps its rows, with 0 for NULL; whether it has one is an aggregate per key that combines before the shuffle.
    """
    if training:
        return df.na.drop(subset=[*columns, target])
    marked = df.withColumn("_ok", complete(columns))
    if bounded:
        judged = marked.withColumn("_any", F.max("_ok").over(Window.partitionBy(key)))
    else:
        judged = attach(marked, marked.groupBy(key).agg(F.max("_ok").alias("_any")), key)
    filled = {c: F.when(F.col("_any"), F.col(c)).otherwise(F.coalesce(c, F.lit(0.0))) for c in [*columns, target]}
    return judged.filter(F.col("_ok") | ~F.col("_any")).withColumns(filled).drop("_ok", "_any")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, nulls) for the columns that have any, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "nulls").filter("nulls > 0")


def allowed(df: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows whose normalised ticker is in the allow-list."""
    return attach(df, symbols.select("symbol"), spread=[c for c in df.columns if c != "symbol"], how="left_semi")


def rejected(df: DataFrame, symbols: DataFrame) -> DataFrame:
    return attach(df, symbols.select("symbol"), spread=[c for c in df.columns if c != "symbol"], how="left_anti")
