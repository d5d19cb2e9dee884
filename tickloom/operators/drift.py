"""Distribution drift per symbol and feature, and the verdict per symbol."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalar import ratio
from tickloom.operators.columns import align_reference_mean
from tickloom.operators.ordered import cumulative, quantile_of, share_upto
from tickloom.operators.series import attach
from tickloom.schemas import TARGET
from tickloom.session import written

KEYS = ["symbol", "feature"]
MIN_ROWS = 5
SHARE = 0.5
THRESHOLDS = {"ks": 0.05, "wasserstein": 0.1, "psi": 0.1}
MIN_SCALE = 0.001
MIN_SHARE = 0.0001
DECILES = {f"q{i}": i / 10 for i in range(1, 10)}


def feature_columns(df: DataFrame) -> list[str]:
    """Columns to compare: everything but keys, dates, the target and left-over index columns."""
    return [c for c in df.columns if c not in {"symbol", "date", "Date", TARGET} and not c.startswith("Unnamed")]


def gated(reference: DataFrame, current: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Symbols with a reference and at least ``min_rows`` current rows."""
    counts = current.groupBy("symbol").agg(F.count(F.lit(1)).alias("current_rows")).filter(F.col("current_rows") >= min_rows)
    return counts.join(reference.select("symbol").distinct(), "symbol", "left_semi")


def long_sides(
    reference: DataFrame, current: DataFrame, features: Sequence[str] | None = None, missing: str = "skip"
) -> DataFrame:
    """Both sides as (symbol, feature, side, value).

    A feature that only the reference has is skipped, or compared as its reference mean with ``missing="ref_mean"``.
    """
    features = list(features or feature_columns(reference))
    if missing == "ref_mean":
        current = align_reference_mean(current, reference, features)
    shared = [c for c in features if c in current.columns]

    def long(df: DataFrame, side: str) -> DataFrame:
        typed = df.select("symbol", *[F.col(c).cast("double").alias(c) for c in shared])
        return typed.unpivot("symbol", shared, "feature", "value").withColumn("side", F.lit(side))

    both = long(reference, "reference").unionByName(long(current, "current"))
    return both.filter(F.col("value").isNotNull()).select(*KEYS, "side", "value")


def drift_input(
    reference: DataFrame, current: DataFrame, features: Sequence[str] | None = None, missing: str = "skip", min_rows: int = MIN_ROWS
) -> DataFrame:
    """``long_sides`` of the symbols that pass the gate."""
    symbols = gated(reference, current, min_rows).select("symbol")
    return attach(long_sides(reference, current, features, missing), symbols, spread="value", how="left_semi")


def ordered_sides(long: DataFrame) -> DataFrame:
    """Reference and current counts per distinct value, with running totals in value order."""
    measures = {
        "ref": (F.col("side") == "reference").cast("bigint"),
        "cur": (F.col("side") == "current").cast("bigint"),
    }
    return cumulative(long, KEYS, "value", measures)


def ks_p_value(statistic: Column, n: Column, m: Column) -> Column:
    """Asymptotic p-value of the two-sample Kolmogorov-Smirnov statistic."""
    x = F.sqrt(n * m / (n + m)) * statistic

    def term(total: Column, j: Column) -> Column:
        sign = F.when(j % 2 == 1, 1.0).otherwise(-1.0)
        return total + sign * F.exp(-2 * j * j * x * x)

    series = 2 * F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), term)
    return F.when(x < 0.04, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def ks(sides: DataFrame) -> DataFrame:
    """(symbol, feature, statistic, p_value, n_ref, n_cur)."""
    gap = F.abs(share_upto("ref") - share_upto("cur"))
    out = sides.groupBy(*KEYS).agg(
        F.max(gap).alias("statistic"), F.max("ref_total").alias("n_ref"), F.max("cur_total").alias("n_cur")
    )
    n, m = F.col("n_ref").cast("double"), F.col("n_cur").cast("double")
    return out.filter((F.col("n_ref") > 0) & (F.col("n_cur") > 0)).withColumn("p_value", ks_p_value(F.col("statistic"), n, m))


def wasserstein(sides: DataFrame, long: DataFrame) -> DataFrame:
    """First Wasserstein distance over the reference deviation: (symbol, feature, statistic, n_ref, n_cur)."""
    area = F.abs(share_upto("ref") - share_upto("cur")) * (F.col("next_value") - F.col("value"))
    distance = sides.groupBy(*KEYS).agg(
        F.coalesce(F.sum(area), F.lit(0.0)).alias("_d"), F.max("ref_total").alias("n_ref"), F.max("cur_total").alias("n_cur")
    )
    scale = long.filter("side = 'reference'").groupBy(*KEYS).agg(F.stddev_pop("value").alias("_s"))
    joined = distance.filter((F.col("n_ref") > 0) & (F.col("n_cur") > 0)).join(scale, KEYS)
    return joined.select(*KEYS, ratio("_d", F.greatest("_s", F.lit(MIN_SCALE))).alias("statistic"), "n_ref", "n_cur")


def psi(sides: DataFrame) -> DataFrame:
    """Population stability index over the reference deciles: (symbol, feature, statistic, n_ref, n_cur)."""
    known = written(sides.filter((F.col("ref_total") > 0) & (F.col("cur_total") > 0)), "ordered")  # read twice
    deciles = quantile_of(known, KEYS, "value", "ref", DECILES)
    at = [
        F.coalesce(F.max(F.when(F.col("value") <= F.col(q), F.col(f"{m}_upto"))), F.lit(0)).alias(f"{m}_{q}")
        for m in ("ref", "cur")
        for q in DECILES
    ]
    points = attach(known, deciles, KEYS, "value").groupBy(*KEYS).agg(F.max("ref_total").alias("n_ref"), F.max("cur_total").alias("n_cur"), *at)

    def shares(m: str) -> list[Column]:
        edges = [F.lit(0), *[F.col(f"{m}_{q}") for q in DECILES], F.col(f"n_{m}")]
        return [F.greatest((hi - lo) / F.col(f"n_{m}"), F.lit(MIN_SHARE)) for lo, hi in zip(edges, edges[1:])]

    terms = [(c - r) * F.ln(c / r) for r, c in zip(shares("ref"), shares("cur"))]
    return points.select(*KEYS, sum(terms[1:], terms[0]).alias("statistic"), "n_ref", "n_cur")


def drift(
    reference: DataFrame,
    current: DataFrame,
    method: str = "ks",
    threshold: float | None = None,
    features: Sequence[str] | None = None,
    missing: str = "skip",
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """(symbol, feature, method, statistic, threshold, drifted).

    The caller names the test, ``ks``, ``wasserstein`` or ``psi``; it does not depend on the number of rows.
    For ``ks`` the statistic is the p-value and low means drift, for the others high means drift.
    """
    long = long_sides(reference, current, features, missing)
    gate = gated(reference, current, min_rows).select("symbol")  # applied to the few result rows, not to the input
    return judge(long, ordered_sides(long), method, threshold).join(gate, "symbol", "left_semi")


def judge(long: DataFrame, sides: DataFrame, method: str = "ks", threshold: float | None = None) -> DataFrame:
    """Test results from prepared input, see ``drift``."""
    if method == "ks":
        found = ks(sides).select(*KEYS, F.col("p_value").alias("statistic"))
    elif method == "wasserstein":
        found = wasserstein(sides, long).select(*KEYS, "statistic")
    elif method == "psi":
        found = psi(sides).select(*KEYS, "statistic")
    else:
        raise ValueError(f"unknown method {method}")
    limit = F.lit(float(THRESHOLDS[method] if threshold is None else threshold))
    drifted = F.col("statistic") < limit if method == "ks" else F.col("statistic") >= limit
    return found.select(*KEYS, F.lit(method).alias("method"), "statistic", limit.alias("threshold"), drifted.alias("drifted"))


def verdict(report: DataFrame, share: float = SHARE) -> DataFrame:
    """Share of drifted features per symbol and whether it reaches ``share``."""
    actual = F.avg(F.col("drifted").cast("double"))
    return report.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("features"), actual.alias("drift_share"), (actual >= share).alias("dataset_drift")
    )


def retrain_requests(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter("dataset_drift").select("symbol")


def report(
    reference: DataFrame,
    current: DataFrame,
    method: str = "ks",
    threshold: float | None = None,
    features: Sequence[str] | None = None,
    missing: str = "skip",
    min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Per feature: count, mean, deviation and quantiles of both sides, with the test result."""
    long = long_sides(reference, current, features, missing)
    sides = written(ordered_sides(long), "ordered")  # read by the test and by the quantiles of both sides
    gate = gated(reference, current, min_rows).select("symbol")
    out = judge(long, sides, method, threshold).join(gate, "symbol", "left_semi")

    def only(side: str) -> Column:
        return F.when(F.col("side") == side, F.col("value"))

    basic = []
    for side, m in (("reference", "ref"), ("current", "cur")):
        basic += [
            F.count(only(side)).alias(f"{m}_count"),
            F.avg(only(side)).alias(f"{m}_mean"),
            F.stddev_samp(only(side)).alias(f"{m}_std"),
        ]
        marks = {f"{m}_q05": 0.05, f"{m}_q50": 0.5, f"{m}_q95": 0.95}
        out = out.join(quantile_of(sides, KEYS, "value", m, marks), KEYS, "left")
    return out.join(long.groupBy(*KEYS).agg(*basic), KEYS, "left")
