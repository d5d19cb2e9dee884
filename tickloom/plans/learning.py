"""Queries of training input, metrics, trials and scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import features as FT
from tickloom.operators import scoring as SC
from tickloom.operators import sequences as Q
from tickloom.operators.series import windowed
from tickloom.operators.stats import with_return
from tickloom.functions import rolling as R
from tickloom.plans import sql as S
from tickloom.plans.feature_tables import DIGITS, digits, inputs
from tickloom.plans.registry import query, show
from tickloom.plans.sql import W, r
from tickloom.plans.windows import BARS, RETURNS
from tickloom.schemas import FEATURES, TARGET
from tickloom.session import scratch_path
from tickloom.sources import logs as LG
from tickloom.sources import views

SMALL = (
    f"{RETURNS}, f AS (SELECT symbol, date, close, lr, lead(lr) {W} AS target, row_number() {W} - 1 AS rn, "
    "count(*) OVER (PARTITION BY symbol) AS n FROM ret)"
)


def small(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, date, close, lr, target) with NULL on the first or last row."""

    def build(df, w):
        return df.withColumn("lr", R.log_return("close", w)).withColumn("target", F.lead("lr", 1).over(w))

    return windowed(views.bars(spark, sf).select("symbol", "date", "close"), build, before=1, after=1)


# Scaling

SCALE_COLUMNS = ["close", "volume", "flat"]
SCALED = (
    f"{BARS}, b AS (SELECT symbol, date, close, CAST(volume AS DOUBLE) AS volume, CAST(7 AS DOUBLE) AS flat FROM bars), "
    "m AS (SELECT symbol, "
    + ", ".join(f"min({c}) AS {c}_min, max({c}) AS {c}_max" for c in SCALE_COLUMNS)
    + " FROM b GROUP BY symbol), s AS (SELECT symbol, date, "
    + ", ".join(f"({c} - {c}_min) / CASE WHEN {c}_max = {c}_min THEN 1 ELSE {c}_max - {c}_min END AS {c}" for c in SCALE_COLUMNS)
    + " FROM b JOIN m USING (symbol))"
)


def scale_input(spark: SparkSession, sf: str) -> DataFrame:
    return views.bars(spark, sf).select("symbol", "date", "close", F.col("volume").cast("double").alias("volume"), F.lit(7.0).alias("flat"))


@query("minmax_scale", f"{SCALED} SELECT symbol, date, {r('close', 6)} AS close, {r('volume', 6)} AS volume, {r('flat', 6)} AS flat FROM s")
def minmax_scale(spark: SparkSession, sf: str) -> DataFrame:
    b = scale_input(spark, sf)
    return show(Q.minmax_apply(b, Q.minmax_fit(b, SCALE_COLUMNS), SCALE_COLUMNS), "symbol", "date", close=6, volume=6, flat=6)


@query("minmax_inverse", f"{BARS} SELECT symbol, date, {r('close', 4)} AS close FROM bars")
def minmax_inverse(spark: SparkSession, sf: str) -> DataFrame:
    b = scale_input(spark, sf)
    stats = Q.minmax_fit(b, SCALE_COLUMNS)
    scaled = Q.minmax_apply(b, stats, SCALE_COLUMNS).withColumnRenamed("close", "scaled")
    return show(Q.minmax_inverse(scaled, stats, "scaled", "close", "close"), "symbol", "date", close=4)


# Sequences

LENGTH = 3
SEQUENCE_SQL = (
    f"{SMALL}, seq AS (SELECT a.symbol, CAST(a.rn - {LENGTH - 1} AS BIGINT) AS sample, k.k AS step, b.close, b.lr, c.target AS y "
    f"FROM f a, generate_series(0, {LENGTH - 1}) k(k), f b, f c WHERE b.symbol = a.symbol AND b.rn = a.rn - {LENGTH - 1} + k.k "
    f"AND c.symbol = a.symbol AND c.rn = a.rn + 1 AND a.rn >= {LENGTH - 1} AND a.rn + 2 < a.n)"
)


@query(
    "sequences",
    f"{SEQUENCE_SQL} SELECT symbol, sample, CAST(step AS INTEGER) AS step, close, {r('lr', 6)} AS lr, {r('y', 6)} AS y FROM seq",
)
def sequences(spark: SparkSession, sf: str) -> DataFrame:
    seq = Q.sequences(small(spark, sf), ["close", "lr"], "target", LENGTH)
    steps = seq.select("symbol", "sample", "y", F.posexplode("sequence").alias("step", "x"))
    out = steps.select("symbol", "sample", "step", "y", F.col("x")[0].alias("close"), F.col("x")[1].alias("lr"))
    return show(out, "symbol", "sample", "step", "close", lr=6, y=6)


@query(
    "sequences_flat",
    f"{SEQUENCE_SQL} SELECT symbol, sample, CAST(2 * step + j.j AS INTEGER) AS position, "
    f"{r('CASE WHEN j.j = 0 THEN close ELSE lr END', 6)} AS x FROM seq, generate_series(0, 1) j(j)",
)
def sequences_flat(spark: SparkSession, sf: str) -> DataFrame:
    seq = Q.flat(Q.sequences(small(spark, sf), ["close", "lr"], "target", LENGTH))
    return show(seq.select("symbol", "sample", F.posexplode("sequence").alias("position", "x")), "symbol", "sample", "position", x=6)


@query(
    "scoring_window",
    f"{SMALL}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM f) "
    f"SELECT symbol, CAST(24 - back AS INTEGER) AS step, close, {r('lr', 6)} AS lr FROM t WHERE back <= 24",
)
def scoring_window(spark: SparkSession, sf: str) -> DataFrame:
    seq = Q.scoring_window(small(spark, sf), ["close", "lr"], 24)
    steps = seq.select("symbol", F.posexplode("sequence").alias("step", "x"))
    return show(steps.select("symbol", "step", F.col("x")[0].alias("close"), F.col("x")[1].alias("lr")), "symbol", "step", "close", lr=6)


# Splits


@query("split_80_20", f"{SMALL} SELECT symbol, date, CASE WHEN rn < floor(0.8 * n) THEN 'train' ELSE 'test' END AS role FROM f")
def split_80_20(spark: SparkSession, sf: str) -> DataFrame:
    return Q.split_fraction(views.bars(spark, sf).select("symbol", "date"), 0.8)


@query("split_last_90", f"{SMALL} SELECT symbol, date, CASE WHEN rn < n - 90 THEN 'train' ELSE 'test' END AS role FROM f")
def split_last_90(spark: SparkSession, sf: str) -> DataFrame:
    return Q.split_last(views.bars(spark, sf).select("symbol", "date"), 90)


@query(
    "ts_folds",
    f"{SMALL}, k AS (SELECT symbol, date, rn, CAST(k AS INTEGER) AS fold, n - (6 - k) * (n // 6) AS start, n // 6 AS size FROM f, generate_series(1, 5) g(k)) "
    "SELECT symbol, fold, date, CASE WHEN rn < start THEN 'train' ELSE 'test' END AS role FROM k WHERE rn < start + size",
)
def ts_folds(spark: SparkSession, sf: str) -> DataFrame:
    return Q.expanding_folds(views.bars(spark, sf).select("symbol", "date")).select("symbol", "fold", "date", "role")


@query(
    "min_samples_gate",
    "SELECT o_custkey AS symbol, count(*) AS samples FROM orders GROUP BY o_custkey HAVING count(*) >= 15",
)
def min_samples_gate(spark: SparkSession, sf: str) -> DataFrame:
    return Q.enough_samples(views.table(spark, sf, "orders").select(F.col("o_custkey").alias("symbol")), 15)


# Metrics

PRED = "WITH p AS (SELECT l_returnflag AS symbol, l_discount - 0.05 AS y, l_tax - 0.04 AS p FROM lineitem)"


@query("metric_rmse_mae", f"{PRED} SELECT symbol, {r('sqrt(avg((y - p) * (y - p)))', 6)} AS rmse, {r('avg(abs(y - p))', 6)} AS mae FROM p GROUP BY symbol")
def metric_rmse_mae(spark: SparkSession, sf: str) -> DataFrame:
    return show(Q.regression_metrics(views.predictions(spark, sf)), "symbol", rmse=6, mae=6)


@query("metric_hit_rate", f"{PRED} SELECT symbol, {r('avg(CASE WHEN sign(y) = sign(p) THEN 1.0 ELSE 0.0 END) * 100', 6)} AS hit_rate FROM p GROUP BY symbol")
def metric_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    return show(Q.regression_metrics(views.predictions(spark, sf)), "symbol", hit_rate=6)


@query(
    "metric_r2_mape",
    f"{PRED} SELECT symbol, {r('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y))', 6)} AS r2, {r('avg(abs((y - p) / nullif(y, 0)))', 6)} AS mape FROM p GROUP BY symbol",
)
def metric_r2_mape(spark: SparkSession, sf: str) -> DataFrame:
    return show(Q.regression_metrics(views.predictions(spark, sf)), "symbol", r2=6, mape=6)


@query(
    "evaluate",
    f"{SMALL}, ok AS (SELECT *, row_number() {W} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS m FROM f WHERE lr IS NOT NULL AND target IS NOT NULL), "
    "s AS (SELECT symbol, min(target) AS lo, max(target) AS hi FROM ok GROUP BY symbol), "
    "t AS (SELECT symbol, target AS y, (0.4 * (target - lo) / (hi - lo) + 0.3) * (hi - lo) + lo AS p FROM ok JOIN s USING (symbol) WHERE i >= floor(0.8 * m)) "
    f"SELECT symbol, count(*) AS n, {r('sqrt(avg((y - p) * (y - p)))', 6)} AS rmse, {r('avg(abs(y - p))', 6)} AS mae FROM t GROUP BY symbol",
)
def evaluate(spark: SparkSession, sf: str) -> DataFrame:
    """Error on the unscaled target of the last fifth, for a scaled prediction of 0.4 y + 0.3."""
    data = small(spark, sf).na.drop().select("symbol", "date", "target")
    stats = Q.minmax_fit(data, ["target"])
    test = Q.split_fraction(data, 0.8).filter("role = 'test'")
    scaled = Q.minmax_apply(test, stats, ["target"]).withColumn("guess", F.col("target") * 0.4 + 0.3)
    y = Q.minmax_inverse(scaled, stats, "target", "target", "y")
    p = Q.minmax_inverse(y, stats, "guess", "target", "p")
    return show(Q.regression_metrics(p), "symbol", "n", rmse=6, mae=6)


@query(
    "cv_rank",
    "WITH c AS (SELECT l_suppkey AS trial_id, l_linenumber AS split, -avg(l_discount) AS score FROM lineitem GROUP BY ALL), "
    "t AS (SELECT trial_id, avg(score) AS m, stddev_pop(score) AS s FROM c GROUP BY trial_id) "
    f"SELECT trial_id, {r('m', 6)} AS mean_score, {r('s', 6)} AS std_score, rank() OVER (ORDER BY round(m, 9) DESC) AS rank FROM t",
)
def cv_rank(spark: SparkSession, sf: str) -> DataFrame:
    return show(Q.cv_rank(views.cv_scores(spark, sf)), "trial_id", "rank", mean_score=6, std_score=6)


CHOICES = [(m, k, v) for m, axes in Q.SEARCH_SPACE.items() for k, values in axes.items() for v in values]


@query(
    "trial_sample",
    "WITH space(model_type, name, value) AS (VALUES " + ", ".join(f"('{m}', '{k}', '{v}')" for m, k, v in CHOICES) + "), "
    "t AS (SELECT symbol, CAST(i AS INTEGER) AS trial FROM (SELECT DISTINCT p_brand AS symbol FROM part), generate_series(1, 5) g(i)), "
    "m AS (SELECT symbol, trial, arg_min(model_type, md5(concat_ws('-', '42', symbol, trial, 'model_type', model_type))) AS model_type "
    "FROM t, (SELECT DISTINCT model_type FROM space) GROUP BY symbol, trial), "
    "v AS (SELECT symbol, trial, model_type, name, arg_min(value, md5(concat_ws('-', '42', symbol, trial, name, value))) AS value "
    "FROM m JOIN space USING (model_type) GROUP BY symbol, trial, model_type, name) "
    "SELECT symbol, trial, model_type, "
    + ", ".join(f"coalesce(max(CASE WHEN name = '{k}' THEN value END), '{d}') AS {k}" for k, d in Q.TRIAL_DEFAULTS.items())
    + " FROM v GROUP BY symbol, trial, model_type",
)
def trial_sample(spark: SparkSession, sf: str) -> DataFrame:
    return Q.sample_trials(views.trials(spark, sf).select("symbol").distinct())


# Scoring


@query(
    "price_forecast",
    f"{RETURNS} SELECT symbol, date, {r('close * exp(0.5 * lr)', 4)} AS predicted_price, {r('(exp(0.5 * lr) - 1) * 100', 5)} AS predicted_variation FROM ret WHERE lr IS NOT NULL",
)
def price_forecast(spark: SparkSession, sf: str) -> DataFrame:
    rets = with_return(views.bars(spark, sf)).withColumn("predicted_return", 0.5 * F.col("log_return"))
    return show(SC.forecast(rets, "close"), "symbol", "date", predicted_price=4, predicted_variation=5)


@query(
    "prediction_output",
    f"{RETURNS} SELECT symbol, close AS current_price, {r('close * exp(0.5 * lr)', 2)} AS predicted_price_tomorrow, {r('(exp(0.5 * lr) - 1) * 100', 4)} AS variation_pct, "
    "strftime(date, '%Y-%m-%d') AS timestamp, CAST(NULL AS VARCHAR) AS message FROM ret",
)
def prediction_output(spark: SparkSession, sf: str) -> DataFrame:
    def build(df, w):
        return df.withColumn("predicted_return", F.coalesce(0.5 * R.log_return("close", w), F.lit(float("nan"))))

    rows = windowed(views.bars(spark, sf), build, before=1).select(
        "symbol", F.col("close").alias("last_price"), F.col("date").alias("last_date"), "predicted_return"
    )
    out = SC.prediction_output(SC.forecast(rows))
    return show(out, "symbol", "current_price", "timestamp", "message", predicted_price_tomorrow=2, variation_pct=4)


# (row from the end, feature, weight): a fixed linear model over several features and rows
WEIGHTS = [
    (-1, "Log_Return", 0.3), (-2, "Log_Return", 0.15), (-1, "RSI_14", -0.1), (-1, "MACD_Histogram", 0.1), (-3, "MACD_Signal", 0.05),
    (-1, "SP500_Return", 0.1), (-2, "VIX_Return", -0.05), (-1, "Sentiment_Score", 0.1), (-1, "Volume_Shock", 0.05), (-2, "OBV_ROC_5", 0.05),
    (-1, "ATR_Pct", 0.05), (-3, "Bollinger_Width", 0.05), (-1, "Day_Sin", 0.02), (-1, "Lag_5", 0.05),
]
SCALED_FEATURES = sorted({f for _, f, _ in WEIGHTS})
WINDOW_ROWS = 3
JOB_TIME = "2026-01-02 03:04:05.678901"
BATCH_SQL = (
    f"WITH {S.BARS}, {S.MACRO_RETURNS}, {S.SENTIMENT}, "
    "recent AS (SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS i FROM bars) WHERE i <= 250), "
    f"{S.features('recent')}, ok AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM feat WHERE {S.complete(FEATURES)}), "
    + "s AS (SELECT symbol, "
    + ", ".join(f"min({c}) AS {c}_lo, CASE WHEN max({c}) = min({c}) THEN 1 ELSE max({c}) - min({c}) END AS {c}_w" for c in [*SCALED_FEATURES, TARGET])
    + " FROM ok GROUP BY symbol), p AS (SELECT symbol, "
    + " + ".join(f"{w} * max(CASE WHEN back = {-row} THEN ({c} - {c}_lo) / {c}_w END)" for row, c, w in WEIGHTS)
    + f" AS z FROM ok JOIN s USING (symbol) WHERE back <= {WINDOW_ROWS} GROUP BY symbol), "
    "q AS (SELECT symbol, max_by(close, date) AS price, max(date) AS d FROM bars GROUP BY symbol), "
    f"o AS (SELECT symbol, price, d, z * {TARGET}_w + {TARGET}_lo AS pr FROM p JOIN s USING (symbol) JOIN q USING (symbol))"
)


def batch_inputs(spark: SparkSession, sf: str) -> tuple:
    b, returns, sentiment = inputs(spark, sf)
    scorer = SC.linear_scorer([(row, FEATURES.index(c), w) for row, c, w in WEIGHTS])
    return b, returns, sentiment, scorer, WINDOW_ROWS


@query(
    "batch_predict",
    f"{BATCH_SQL} SELECT symbol, price AS current_price, {r('price * exp(pr)', 2)} AS predicted_price_tomorrow, {r('(exp(pr) - 1) * 100', 4)} AS variation_pct, "
    "strftime(d, '%Y-%m-%d') AS timestamp, CAST(NULL AS VARCHAR) AS message, true AS scaler_applied FROM o",
)
def batch_predict(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts of all symbols from the last three rows of all 26 features, scaled, by a fixed linear model over 14 of their values."""
    b, returns, sentiment, scorer, length = batch_inputs(spark, sf)
    recent = SC.recent_history(b)
    table = SC.recent_features(recent, returns, sentiment)
    scaler = SC.batch_scaler(recent, returns, sentiment, table=table)
    out = SC.with_output(SC.scored_batch(recent, returns, sentiment, scorer, length, scaler, table=table))
    return show(out, "symbol", "current_price", "timestamp", "message", "scaler_applied", predicted_price_tomorrow=2, variation_pct=4)


@query(
    "batch_predict_log",
    f"{BATCH_SQL} SELECT symbol, '{JOB_TIME.replace(' ', 'T')}' AS timestamp, 'champion' AS model_version, 'nightly-1' AS job, strftime(d, '%Y-%m-%d') AS day, "
    f"price AS current_price, {r('price * exp(pr)', 2)} AS predicted_price_tomorrow, "
    + ", ".join(f"{S.r(c, DIGITS[c])} AS {c}" for c in FEATURES)
    + " FROM o JOIN ok USING (symbol) WHERE back = 1",
)
def batch_predict_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log that two runs of one scoring job leave: a record a symbol, with the unscaled features of its newest row."""
    b, returns, sentiment, scorer, length = batch_inputs(spark, sf)
    recent = SC.recent_history(b)
    table = SC.recent_features(recent, returns, sentiment)
    scaler = SC.batch_scaler(recent, returns, sentiment, table=table)
    path = scratch_path(spark, "prediction-log")
    at = F.lit(JOB_TIME).cast("timestamp_ntz")
    for _ in range(2):  # the second run is a retry of the first
        SC.predict_and_log(recent, returns, sentiment, scorer, length, path, "nightly-1", at, scaler=scaler, table=table)
    logs = LG.read_jobs(spark, path)
    flat = LG.flatten_features(logs, FEATURES, keep=("symbol", "timestamp", "model_version", "job", "prediction_output"))
    out = flat.withColumns({"day": F.col("prediction_output.timestamp"), "current_price": F.col("prediction_output.current_price")})
    out = out.withColumn("predicted_price_tomorrow", F.col("prediction_output.predicted_price_tomorrow"))
    return show(out, "symbol", "timestamp", "model_version", "job", "day", "current_price", "predicted_price_tomorrow", **digits(FEATURES))


assert FT.columns_of(FT.FULL) == FEATURES
