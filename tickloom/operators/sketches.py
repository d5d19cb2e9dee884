"""Quantile sketches: a bounded summary per key that is stored per batch and merged, beside the exact operators.

A sketch (KLL, built into Spark) answers ranks and quantiles with an error of at most ``rank_error(k)`` of all rows, with a
confidence of 99 %, whatever the number of rows. Sketches of batches merge without reading the rows again, so old rows may be gone.
The caller chooses: functions here are approximate, those of ``drift`` and ``stats`` exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import drift as D
from tickloom.operators.series import attach
from tickloom.sources import versions

KEYS = D.KEYS
K = 4096
POINTS = 1024  # values that stand for a side where two are compared


def rank_error(k: int = K) -> float:
    """Largest error of a rank, as a share of all rows."""
    return 2.296 / k**0.9021


def sketched(rows: DataFrame, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """``keys, sketch, n, total, squares, low, high`` of the values that are not NULL; combined before the shuffle."""
    v = F.col(value).cast("double")
    return rows.filter(v.isNotNull()).groupBy(*keys).agg(
        F.kll_sketch_agg_double(v, k).alias("sketch"), F.count("*").alias("n"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"),
        F.min(v).alias("low"), F.max(v).alias("high"),
    )


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One sketch per key from several."""
    return sketches.groupBy(*keys).agg(
        F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    )


def append_sketches(sketches: DataFrame, path: str, batch: str) -> None:
    """Store the sketches of a batch; a batch that runs again replaces its own."""
    version = versions.begin()
    sketches.write.parquet(versions.folder(path, batch, version))
    versions.commit(sketches.sparkSession, path, batch, version)


def read_sketches(spark: SparkSession, path: str, like: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All stored batches as one sketch per key."""
    return merged(versions.read_committed(spark, path, like.schema), keys)


def quantiles(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """Approximate quantiles as columns named by ``shares``."""
    return sketches.withColumns({name: F.kll_sketch_get_quantile_double("sketch", F.lit(share)) for name, share in shares.items()})


def clip_quantile(bars: DataFrame, c: str = "volume", p: float = 0.99, k: int = K) -> DataFrame:
    """``<c>_clipped``: the value limited to [0, approximate quantile of its symbol]."""
    top = quantiles(sketched(bars, ["symbol"], c, k), {"_top": p}).select("symbol", "_top")
    return attach(bars, top).withColumn(f"{c}_clipped", F.least(F.greatest(F.col(c), F.lit(0)).cast("double"), "_top")).drop("_top")


def as_rows(sketches: DataFrame, side: str, points: int = POINTS) -> DataFrame:
    """``points`` values of each key that stand for all its values: the quantiles in the middle of as many equal shares."""
    shares = F.array(*[F.lit((j + 0.5) / points) for j in range(points)])
    values = F.explode(F.kll_sketch_get_quantile_double("sketch", shares)).alias("value")
    return sketches.select(*KEYS, F.lit(side).alias("side"), values)


def both_sides(reference: DataFrame, current: DataFrame, points: int = POINTS) -> tuple[DataFrame, DataFrame]:
    """Two tables of sketches per symbol and feature as rows, and these in value order: input for the exact statistics."""
    shared = reference.select(*KEYS).join(current.select(*KEYS), KEYS)
    sides = [as_rows(s.join(shared, KEYS, "left_semi"), m, points) for s, m in ((reference, "reference"), (current, "current"))]
    long = sides[0].unionByName(sides[1])
    return long, D.ordered_sides(long)


def ks(reference: DataFrame, current: DataFrame, points: int = POINTS) -> DataFrame:
    """(symbol, feature, statistic, p_value, n_ref, n_cur); the statistic is at most ``gap_error`` away from the exact one."""
    found = D.ks(both_sides(reference, current, points)[1]).select(*KEYS, "statistic")
    for sketches, m in ((reference, "n_ref"), (current, "n_cur")):
        found = found.join(sketches.select(*KEYS, F.col("n").alias(m)), KEYS)
    n, m = F.col("n_ref").cast("double"), F.col("n_cur").cast("double")
    return found.select(*KEYS, "statistic", D.ks_p_value(F.col("statistic"), n, m).alias("p_value"), "n_ref", "n_cur")


def gap_error(k: int = K, points: int = POINTS) -> float:
    """How far the statistic of ``ks`` can be from the exact one: a rank and half a step between points on either side."""
    return 2 * rank_error(k) + 1 / points


def drift(reference: DataFrame, current: DataFrame, method: str = "ks", threshold: float | None = None) -> DataFrame:
    """(symbol, feature, method, statistic, threshold, drifted) from sketches per symbol and feature; methods as in ``drift.drift``."""
    if method != "ks":
        return D.judge(*both_sides(reference, current), method, threshold)
    limit = F.lit(float(D.THRESHOLDS[method] if threshold is None else threshold))
    found = ks(reference, current).select(*KEYS, F.lit(method).alias("method"), F.col("p_value").alias("statistic"), limit.alias("threshold"))
    return found.withColumn("drifted", F.col("statistic") < F.col("threshold"))
