"""Batch scoring: history to a price forecast per symbol, all symbols in one job."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalar import null_if_nan, price_after, variation_pct
from tickloom.operators import columns as C
from tickloom.operators import features as FT
from tickloom.operators.selection import last_quote, tail
from tickloom.operators.sequences import minmax_fit, minmax_original, minmax_value
from tickloom.schemas import FEATURES, TARGET
from tickloom.session import written
from tickloom.sources.logs import append_job, build_log

HISTORY_ROWS = 250
Scorer = Callable[[DataFrame], DataFrame]


def linear_scorer(weights: Sequence[tuple[int, int, float]]) -> Scorer:
    """Weighted sum of window entries (row, feature index, weight) as ``prediction``; row -1 is the latest."""

    def score(df: DataFrame) -> DataFrame:
        terms = [F.element_at(F.element_at("sequence", row), feature + 1) * F.lit(weight) for row, feature, weight in weights]
        return df.withColumn("prediction", sum(terms[1:], terms[0]))

    return score


def scaler_matches(stats: DataFrame, columns: Sequence[str]) -> bool:
    """Whether a fitted scaler covers exactly these columns."""
    fitted = {c[: -len("_min")] for c in stats.columns if c.endswith("_min")}
    return fitted == set(columns)


def forecast(df: DataFrame, price: str = "last_price", log_return: str = "predicted_return") -> DataFrame:
    """Price and percent change that a predicted log return implies."""
    return df.withColumns(
        {"predicted_price": price_after(price, log_return), "predicted_variation": variation_pct(log_return)}
    )


def prediction_output(df: DataFrame, *keep: str) -> DataFrame:
    """Output fields, and those to ``keep``: two decimals for prices, four for the change, NULL where the prediction is not a number."""
    return df.select(
        "symbol",
        F.round("last_price", 2).alias("current_price"),
        F.round(null_if_nan("predicted_price"), 2).alias("predicted_price_tomorrow"),
        F.round(null_if_nan("predicted_variation"), 4).alias("variation_pct"),
        F.date_format("last_date", "yyyy-MM-dd").alias("timestamp"),
        F.lit(None).cast("string").alias("message"),
        *keep,
    )


def recent_history(history: DataFrame, rows: int = HISTORY_ROWS) -> DataFrame:
    """The last ``rows`` rows of each symbol, written: what a forecast needs of a history."""
    return written(tail(history, rows), "recent")


def recent_features(recent: DataFrame, macro_returns: DataFrame | None, sentiment: DataFrame | None) -> DataFrame:
    """All features and the target of the recent history, written: the scaler and every run of a job read them, macro and news data are read once."""
    return written(FT.features(recent, macro_returns, sentiment, training=False, bounded=True), "features")


def scored_batch(
    recent: DataFrame,
    macro_returns: DataFrame | None,
    sentiment: DataFrame | None,
    scorer: Scorer,
    length: int,
    scaler: DataFrame | None = None,
    features: Sequence[str] = FEATURES,
    table: DataFrame | None = None,
) -> DataFrame:
    """One row per symbol: last quote, ``predicted_return``, the forecast fields, ``scaler_applied``, and the newest value of each feature, unscaled.

    ``recent`` is what ``recent_history`` keeps, so that a symbol is one window. ``scorer`` gets (symbol, date, sequence) and adds
    ``prediction``: a fitted MLlib model or any expression. ``table`` is what ``recent_features`` has written of the same input, if it has.
    """
    table = FT.features(recent, macro_returns, sentiment, training=False, bounded=True) if table is None else table
    aligned = C.scrub(C.align_zero(table, features), features)
    newest = F.max_by(F.struct(*features), "date").alias("_newest")
    applied = scaler is not None and scaler_matches(scaler, [*features, TARGET])
    values = {c: minmax_value(c) if applied else F.col(c) for c in features}
    # a symbol's rows, and what it has of the scaler, meet in one aggregate per symbol
    sequence = F.sort_array(F.collect_list(F.struct("date", F.array(*values.values()).alias("x"))))
    kept = aligned.join(scaler, "symbol") if applied else aligned
    windows = kept.groupBy("symbol").agg(F.max("date").alias("date"), newest, sequence.alias("_r"))
    padding = F.array_repeat(F.array(*[F.lit(0.0)] * len(features)), F.lit(length) - F.size("_r"))
    last = F.slice("_r", F.greatest(F.size("_r") - length + 1, F.lit(1)), length)
    scored = scorer(windows.select("symbol", "date", "_newest", F.concat(padding, F.transform(last, lambda r: r["x"])).alias("sequence")))
    if applied:
        scored = scored.join(scaler.select("symbol", f"{TARGET}_min", f"{TARGET}_max"), "symbol")
        scored = scored.withColumn("predicted_return", minmax_original("prediction", TARGET))
    else:
        scored = scored.withColumn("predicted_return", F.col("prediction"))
    quoted = scored.select("symbol", "predicted_return", "_newest").join(last_quote(recent), "symbol")
    return forecast(quoted).withColumn("scaler_applied", F.lit(applied)).select("*", "_newest.*").drop("_newest")


def batch_scaler(recent: DataFrame, macro_returns: DataFrame | None, sentiment: DataFrame | None, features: Sequence[str] = FEATURES, table: DataFrame | None = None) -> DataFrame:
    """A scaler of the features and the target over the complete rows of the recent history; ``table`` as in ``scored_batch``."""
    table = FT.features(recent, macro_returns, sentiment, training=False, bounded=True) if table is None else table
    return written(minmax_fit(table, [*features, TARGET]), "scaler")


def predict_batch(history: DataFrame, *args, **options) -> DataFrame:
    """Forecast fields per symbol plus ``scaler_applied``, from whole histories; the other arguments are those of ``scored_batch``."""
    return with_output(scored_batch(recent_history(history), *args, **options))


def with_output(scored: DataFrame) -> DataFrame:
    return prediction_output(scored, "scaler_applied")


def log_records(scored: DataFrame, features: Sequence[str] = FEATURES, ts: str = "ts") -> DataFrame:
    """Log records of scored rows, which also have the time ``ts`` of the job."""
    out = prediction_output(scored, ts, *features)
    fields = F.struct("symbol", "current_price", "predicted_price_tomorrow", "variation_pct", "timestamp", "message")
    return build_log(out.withColumn("prediction_output", fields), features, ts)


def predict_and_log(recent: DataFrame, macro_returns: DataFrame | None, sentiment: DataFrame | None, scorer: Scorer, length: int, path: str, job: str, ts: Column, **options) -> DataFrame:
    """Score all symbols and append one log record each to ``path``; the job ``job`` may run again. The forecasts come back.

    The scores are written before, so that what is logged and what is returned are the same rows.
    """
    features = options.get("features", FEATURES)
    scored = written(scored_batch(recent, macro_returns, sentiment, scorer, length, **options).withColumn("ts", ts), "scored")
    append_job(log_records(scored, features), path, job)
    return with_output(scored)
