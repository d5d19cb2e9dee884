"""Keep-last upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def latest(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """The row with the highest ``version`` per key.

    An aggregate instead of a window: versions of one key combine before the shuffle, however many copies it has.
    """
    values = [c for c in df.columns if c not in keys and c != version]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*values), version).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values])


def upsert_keep_last(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """All keys of both sides; where both have one, the new row wins."""
    both = union(old.withColumn("_version", F.lit(0)), new.withColumn("_version", F.lit(1)))
    return latest(both, list(keys), "_version").select(*old.columns, *[c for c in new.columns if c not in old.columns])
