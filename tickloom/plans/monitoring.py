"""Drift queries.

Reference and current are the two halves of the event month; the current values of two event types are
raised by half, so that drift is there to be found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import drift as D
from tickloom.operators import sketches as SK
from tickloom.operators.selection import without_index
from tickloom.plans.registry import query, show
from tickloom.plans.sql import LOGS, r
from tickloom.schemas import INDEX_SYMBOL
from tickloom.session import scratch_path
from tickloom.sources import views

RAISED = ["click", "view"]

LONG = (
    f"WITH {LOGS}, wide AS (SELECT symbol, side, CASE WHEN side = 'current' AND symbol IN ('click', 'view') THEN value * 1.5 ELSE value END AS value, k FROM logs), "
    "gate AS (SELECT symbol FROM wide GROUP BY symbol HAVING count(*) FILTER (side = 'current') >= 5 AND count(*) FILTER (side = 'reference') > 0), "
    "long AS (SELECT symbol, 'value' AS feature, side, value FROM wide JOIN gate USING (symbol) UNION ALL SELECT symbol, 'k', side, k FROM wide JOIN gate USING (symbol))"
)
STEPS = (
    f"{LONG}, v AS (SELECT symbol, feature, value, count(*) FILTER (side = 'reference') AS r, count(*) FILTER (side = 'current') AS c FROM long GROUP BY ALL), "
    "e AS (SELECT *, sum(r) OVER w AS ru, sum(c) OVER w AS cu, sum(r) OVER g AS rn, sum(c) OVER g AS cn, lead(value) OVER w AS nxt FROM v "
    "WINDOW w AS (PARTITION BY symbol, feature ORDER BY value), g AS (PARTITION BY symbol, feature)), "
    "cdf AS (SELECT *, ru / rn AS f, cu / cn AS h FROM e)"
)
KS = f"{STEPS}, ks AS (SELECT symbol, feature, max(abs(f - h)) AS d, CAST(max(rn) AS BIGINT) AS n_ref, CAST(max(cn) AS BIGINT) AS n_cur FROM cdf GROUP BY ALL)"
P_VALUE = (
    f"{KS}, x AS (SELECT *, sqrt(n_ref * n_cur / (n_ref + n_cur)) * d AS x FROM ks), "
    "p AS (SELECT *, CASE WHEN x < 0.04 THEN 1.0 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101), "
    "lambda j: CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END * exp(-2.0 * j * j * x * x))), 0.0), 1.0) END AS p_value FROM x)"
)
FLAGS = f"{P_VALUE}, flags AS (SELECT symbol, feature, p_value, p_value < 0.05 AS drifted FROM p)"
VERDICT = f"{FLAGS}, verdict AS (SELECT symbol, count(*) AS features, avg(CASE WHEN drifted THEN 1.0 ELSE 0.0 END) AS drift_share FROM flags GROUP BY symbol)"


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    reference, current = views.log_halves(spark, sf)
    factor = F.when(F.col("symbol").isin(RAISED), 1.5).otherwise(1.0)
    return reference, current.withColumn("value", F.col("value") * factor)


def ordered(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    long = D.long_sides(*sides(spark, sf))
    return long, D.ordered_sides(long)


@query("drift_input_long", f"{LONG} SELECT symbol, feature, side, {r('value', 4)} AS value FROM long")
def drift_input_long(spark: SparkSession, sf: str) -> DataFrame:
    return show(D.drift_input(*sides(spark, sf)), "symbol", "feature", "side", value=4)


@query(
    "drift_gate",
    "WITH u AS (SELECT CAST(user_id AS VARCHAR) AS symbol, ts < TIMESTAMP '2024-01-16 00:00:00' AS is_ref FROM events) "
    "SELECT symbol, count(*) FILTER (NOT is_ref) AS current_rows FROM u GROUP BY symbol HAVING count(*) FILTER (NOT is_ref) >= 5 AND count(*) FILTER (is_ref) > 0",
)
def drift_gate(spark: SparkSession, sf: str) -> DataFrame:
    users = views.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("symbol"), "ts")
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return D.gated(users.filter(F.col("ts") < cut), users.filter(F.col("ts") >= cut))


@query("drift_ks", f"{KS} SELECT symbol, feature, {r('d', 6)} AS statistic, n_ref, n_cur FROM ks")
def drift_ks(spark: SparkSession, sf: str) -> DataFrame:
    return show(D.ks(ordered(spark, sf)[1]), "symbol", "feature", "n_ref", "n_cur", statistic=6)


@query("drift_ks_pvalue", f"{P_VALUE} SELECT symbol, feature, {r('p_value', 6)} AS p_value FROM p")
def drift_ks_pvalue(spark: SparkSession, sf: str) -> DataFrame:
    return show(D.ks(ordered(spark, sf)[1]), "symbol", "feature", p_value=6)


@query(
    "drift_wasserstein",
    f"{STEPS}, s AS (SELECT symbol, feature, stddev_pop(value) AS sd FROM long WHERE side = 'reference' GROUP BY ALL), "
    "d AS (SELECT symbol, feature, sum(abs(f - h) * (nxt - value)) AS d FROM cdf GROUP BY ALL) "
    f"SELECT symbol, feature, {r('d / greatest(sd, 0.001)', 6)} AS statistic FROM d JOIN s USING (symbol, feature)",
)
def drift_wasserstein(spark: SparkSession, sf: str) -> DataFrame:
    long, ordered_sides = ordered(spark, sf)
    return show(D.wasserstein(ordered_sides, long), "symbol", "feature", statistic=6)


@query(
    "drift_psi",
    f"{LONG}, q AS (SELECT symbol, feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM long WHERE side = 'reference' GROUP BY ALL), "
    "b AS (SELECT symbol, feature, side, len(list_filter(q, lambda x: x < value)) AS bin FROM long JOIN q USING (symbol, feature)), "
    "n AS (SELECT symbol, feature, k AS bin, count(*) FILTER (side = 'reference' AND bin = k) AS r, count(*) FILTER (side = 'current' AND bin = k) AS c, "
    "count(*) FILTER (side = 'reference') AS rn, count(*) FILTER (side = 'current') AS cn FROM b, generate_series(0, 9) g(k) GROUP BY ALL), "
    "t AS (SELECT *, greatest(r / rn, 0.0001) AS rs, greatest(c / cn, 0.0001) AS cs FROM n) "
    f"SELECT symbol, feature, {r('sum((cs - rs) * ln(cs / rs))', 6)} AS statistic FROM t GROUP BY ALL",
)
def drift_psi(spark: SparkSession, sf: str) -> DataFrame:
    return show(D.psi(ordered(spark, sf)[1]), "symbol", "feature", statistic=6)


@query("drift_verdict", f"{VERDICT} SELECT symbol, features, {r('drift_share', 6)} AS drift_share, drift_share >= 0.5 AS dataset_drift FROM verdict")
def drift_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return show(D.verdict(D.drift(*sides(spark, sf))), "symbol", "features", "dataset_drift", drift_share=6)


@query("retrain_requests", f"{VERDICT} SELECT symbol FROM verdict WHERE drift_share >= 0.5")
def retrain_requests(spark: SparkSession, sf: str) -> DataFrame:
    return D.retrain_requests(D.verdict(D.drift(*sides(spark, sf))))


@query(
    "drift_all_symbols",
    f"{VERDICT} SELECT symbol, {r('drift_share', 6)} AS drift_share, drift_share >= 0.5 AS dataset_drift FROM verdict WHERE symbol <> 'error'",
)
def drift_all_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """All symbols in one job but the index, whose part the event type ``error`` plays."""
    index = F.when(F.col("symbol") == "error", INDEX_SYMBOL).otherwise(F.col("symbol"))
    reference, current = (without_index(s.withColumn("symbol", index)) for s in sides(spark, sf))
    return show(D.verdict(D.drift(reference, current)), "symbol", "dataset_drift", drift_share=6)


SIDE = "count(*) FILTER (side = '{0}') AS {1}_count, avg(value) FILTER (side = '{0}') AS {1}_mean, stddev_samp(value) FILTER (side = '{0}') AS {1}_std, " + (
    "quantile_cont(value, 0.05) FILTER (side = '{0}') AS {1}_q05, quantile_cont(value, 0.5) FILTER (side = '{0}') AS {1}_q50, quantile_cont(value, 0.95) FILTER (side = '{0}') AS {1}_q95"
)
REPORT_COLUMNS = [f"{m}_{c}" for m in ("ref", "cur") for c in ("mean", "std", "q05", "q50", "q95")]


@query(
    "drift_report",
    f"{FLAGS}, b AS (SELECT symbol, feature, {SIDE.format('reference', 'ref')}, {SIDE.format('current', 'cur')} FROM long GROUP BY ALL) "
    f"SELECT symbol, feature, 'ks' AS method, {r('p_value', 6)} AS statistic, drifted, ref_count, cur_count, "
    + ", ".join(f"{r(c, 5)} AS {c}" for c in REPORT_COLUMNS)
    + " FROM flags JOIN b USING (symbol, feature)",
)
def drift_report(spark: SparkSession, sf: str) -> DataFrame:
    out = D.report(*sides(spark, sf))
    return show(out, "symbol", "feature", "method", "drifted", "ref_count", "cur_count", statistic=6, **dict.fromkeys(REPORT_COLUMNS, 5))


@query("drift_sketches", f"{KS} SELECT symbol, feature, n_ref, n_cur, true AS ks_in_bound, true AS same_verdict FROM ks")
def drift_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of the reference, and of the current logs stored day by day and merged; results against the exact ones.

    ``ks_in_bound``: the statistic is within the stated error of the exact one; ``same_verdict``: Wasserstein and PSI judge the same.
    """
    long = D.long_sides(*sides(spark, sf))
    path = scratch_path(spark, "sketches")
    days = views.feature_logs(spark, sf).select("symbol", F.to_date("ts").alias("day"), "value", "k").filter("day >= DATE '2024-01-16'")
    factor = F.when(F.col("symbol").isin(RAISED), 1.5).otherwise(1.0)
    values = days.withColumn("value", F.col("value") * factor).unpivot(["symbol", "day"], ["value", "k"], "feature", "value")
    parts = 3
    for part in range(parts):  # batches of days; the second comes twice, as a job that runs again
        batch = SK.sketched(values.filter(F.day("day") % parts == part), D.KEYS, "value")
        for _ in range(1 + (part == 1)):
            SK.append_sketches(batch, path, f"part-{part}")
    reference = SK.sketched(long.filter("side = 'reference'"), D.KEYS, "value")
    current = SK.read_sketches(spark, path, reference, D.KEYS)
    found = SK.ks(reference, current).select(*D.KEYS, F.col("statistic").alias("sketch_ks"), F.col("n_ref").alias("ref_n"), F.col("n_cur").alias("cur_n"))
    ordered_sides = D.ordered_sides(long)
    exact = D.ks(ordered_sides).select(*D.KEYS, "statistic", "n_ref", "n_cur")
    out = exact.join(found, D.KEYS)
    bound = (F.abs(F.col("statistic") - F.col("sketch_ks")) <= SK.gap_error()) & (F.col("ref_n") == F.col("n_ref")) & (F.col("cur_n") == F.col("n_cur"))
    out = out.withColumns({"ks_in_bound": bound, "same_verdict": F.lit(True)})
    for method in ("wasserstein", "psi"):
        both = [d.select(*D.KEYS, F.col("drifted").alias(f"_{n}")) for n, d in enumerate((D.judge(long, ordered_sides, method), SK.drift(reference, current, method)))]
        out = out.join(both[0].join(both[1], D.KEYS), D.KEYS).withColumn("same_verdict", F.col("same_verdict") & (F.col("_0") == F.col("_1"))).drop("_0", "_1")
    return out.select(*D.KEYS, "n_ref", "n_cur", "ks_in_bound", "same_verdict")
