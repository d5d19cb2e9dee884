"""Exploratory statistics: inventory, profiles, histograms, correlations, autocorrelation, seasonal decomposition."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.functions.scalar import ratio
from tickloom.operators.ordered import quantiles
from tickloom.operators.recurrences import State, with_state
from tickloom.operators.series import BLOCK_ROWS, attach, number_rows, windowed
from tickloom.schemas import OHLCV

TRADING_DAYS = 252


def ticker_inventory(bars: DataFrame, columns: Sequence[str] = tuple(OHLCV)) -> DataFrame:
    """Rows, date span, mean share of nulls in percent and close range per symbol."""
    nulls = sum((F.avg(F.col(c).isNull().cast("double")) for c in columns), F.lit(0.0)) / len(columns) * 100
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        nulls.alias("null_pct"),
        F.min("close").alias("close_min"),
        F.max("close").alias("close_max"),
        F.max_by("close", "date").alias("close_last"),
    )


def profile(df: DataFrame) -> DataFrame:
    """(column_name, data_type, non_null, nulls, null_pct), all columns in one pass."""
    kinds = dict(df.dtypes)
    facts = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("data_type"), F.count(c).alias("non_null"))
            for c in df.columns
        ]
    )
    one = df.agg(F.count(F.lit(1)).alias("n"), facts.alias("facts"))
    return one.select("n", F.inline("facts")).select(
        "column_name",
        "data_type",
        "non_null",
        (F.col("n") - F.col("non_null")).alias("nulls"),
        F.coalesce(ratio((F.col("n") - F.col("non_null")) * 100.0, "n"), F.lit(0.0)).alias("null_pct"),
    )


def with_return(bars: DataFrame) -> DataFrame:
    """Bars with ``log_return``, rows without one dropped."""
    out = windowed(bars, lambda d, w: d.withColumn("log_return", R.log_return("close", w)), before=1)
    return out.filter("log_return IS NOT NULL")


def return_stats(returns: DataFrame, c: str = "log_return") -> DataFrame:
    """Mean, sample deviation, range, population skewness and excess kurtosis, yearly Sharpe ratio."""
    mean, std = F.avg(c), F.stddev_samp(c)
    return returns.groupBy("symbol").agg(
        mean.alias("mean"), std.alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis"),
        (ratio(mean, std) * math.sqrt(TRADING_DAYS)).alias("sharpe"),
    )


def seasonality(returns: DataFrame, part: Column, name: str, c: str = "log_return") -> DataFrame:
    """Mean return in percent per symbol and calendar part."""
    return returns.groupBy("symbol", part.alias(name)).agg((F.avg(c) * 100).alias("mean_return_pct"))


def clip_quantile(bars: DataFrame, c: str = "volume", p: float = 0.99) -> DataFrame:
    """``<c>_clipped``: the value limited to [0, exact quantile of its symbol]."""
    top = quantiles(bars, ["symbol"], c, {"_top": p})
    return (
        attach(bars, top).withColumn(f"{c}_clipped", F.least(F.greatest(F.col(c), F.lit(0)).cast("double"), "_top")).drop("_top")
    )


def histogram(df: DataFrame, c: str, bins: int, key: str = "symbol", spread: str = "date") -> DataFrame:
    """Counts per equal-width bin between the minimum and maximum of each key; the last bin is closed."""
    span = df.groupBy(key).agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"))
    place = F.coalesce(F.floor(ratio(F.col(c) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins), F.lit(0))
    return (
        attach(df.filter(F.col(c).isNotNull()), span, key, spread)
        .groupBy(key, F.least(place, F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation over rows where both values exist, NULL if one of them is constant."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def corr_long(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), lower_only: bool = False) -> DataFrame:
    """Correlation matrix in long form (a, b, corr), every pair of columns in one aggregation pass.

    ``lower_only`` keeps the strict lower triangle: a comes after b in column order.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    one = df.groupBy(*keys).agg(
        F.array(
            *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), safe_corr(a, b).alias("corr")) for a, b in pairs]
        ).alias("_pairs"),
        F.array(
            *[
                F.struct(F.lit(a).alias("a"), F.lit(a).alias("b"), F.when(F.stddev_pop(a) > 0, 1.0).alias("corr"))
                for a in columns
            ]
        ).alias("_same"),
    )
    low = one.select(*keys, F.inline("_pairs"))
    if lower_only:
        return low
    both = F.concat(
        "_pairs", F.transform("_pairs", lambda p: F.struct(p["b"].alias("a"), p["a"].alias("b"), p["corr"].alias("corr"))), "_same"
    )
    return one.select(*keys, F.inline(both))


def corr_with_target(df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str] = ()) -> DataFrame:
    """(feature, corr) against the target, ascending; one pass over the rows."""
    one = df.groupBy(*keys).agg(
        F.array(*[F.struct(F.lit(f).alias("feature"), safe_corr(f, target).alias("corr")) for f in features]).alias("_all")
    )
    return one.select(*keys, F.inline("_all")).orderBy(*keys, "corr")


def returns_aligned(returns: DataFrame, symbols: Sequence[str], c: str = "log_return") -> DataFrame:
    """One return column per named symbol on the dates that all of them have. Every symbol is a column: name a few."""
    named = returns.where(F.col("symbol").isin(list(symbols)))
    return named.groupBy("date").pivot("symbol", list(symbols)).agg(F.first(c)).na.drop()


def acf(series: DataFrame, c: str = "log_return", nlags: int = 40, value: Callable[[WindowSpec], Column] | None = None) -> DataFrame:
    """Autocorrelation (symbol, lag, acf, band) for lags 0..nlags with the 95 % Bartlett band.

    The rows are read and numbered once: each block sums the raw products of values ``k`` rows apart and the values in them,
    and the mean, known only at the end, is taken out of the sums algebraically. ``value`` computes the series from
    its rows instead of the column ``c``, by a window that reaches one row back. A row without a value takes part in no pair.
    """
    reach = nlags if value is None else nlags + 1

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        x = df.withColumn("_x", F.col(c).cast("double") if value is None else value(w))
        pairs = {}
        for k in range(nlags + 1):
            earlier = F.lag("_x", k).over(w) if k else F.col("_x")
            pairs |= {f"_p{k}": F.col("_x") * earlier, f"_v{k}": F.col("_x") + earlier}
        return x.withColumns(pairs)

    columns = ["symbol", "date", *([c] if value is None else [n for n in series.columns if n not in ("symbol", "date")])]
    rows = windowed(with_state(series.select(*columns), State()), build, before=reach)
    sums = [a for k in range(nlags + 1) for a in (F.sum(f"_p{k}").alias(f"_p{k}"), F.sum(f"_v{k}").alias(f"_v{k}"), F.count(f"_p{k}").alias(f"_n{k}"))]
    one = rows.groupBy("symbol").agg(*sums).withColumn("_m", ratio("_v0", 2 * F.col("_n0")))
    centred = [F.col(f"_p{k}") - F.col("_m") * F.col(f"_v{k}") + F.col(f"_n{k}") * F.col("_m") * F.col("_m") for k in range(nlags + 1)]
    sums = one.select("symbol", F.col("_n0").alias("_n"), F.posexplode(F.array(*centred)).alias("lag", "_s")).filter("_n > 0")
    group = Window.partitionBy("symbol")
    zero = F.max(F.when(F.col("lag") == 0, F.col("_s"))).over(group)
    out = sums.withColumn("acf", ratio("_s", zero))
    earlier = group.orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    squares = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf"))).over(earlier), F.lit(0.0))
    band = F.when(F.col("lag") == 0, 0.0).otherwise(1.959963984540054 * F.sqrt((1 + 2 * squares) / F.col("_n")))
    return out.select("symbol", "lag", "acf", band.alias("band"))


def pacf(acf_table: DataFrame) -> DataFrame:
    """Partial autocorrelation (symbol, lag, pacf) by the Durbin-Levinson recursion.

    Spark has reduced each series to its lags by now; the recursion folds over that short array.
    """
    ordered = acf_table.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("lag", "acf"))).alias("_r"))
    r = ordered.select("symbol", F.transform("_r", lambda x: x["acf"]).alias("r"))
    start = F.struct(F.array().cast("array<double>").alias("phi"), F.array(F.lit(1.0)).alias("out"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def step(state: Column, k: Column) -> Column:
        phi = state["phi"]
        back = F.reverse(F.slice("r", 2, k - 1))
        ahead = F.slice("r", 2, k - 1)
        top = F.get("r", k) - dot(phi, back)
        last = ratio(top, 1 - dot(phi, ahead))
        moved = F.zip_with(phi, F.reverse(phi), lambda x, y: x - last * y)
        return F.struct(F.concat(moved, F.array(last)).alias("phi"), F.concat(state["out"], F.array(last)).alias("out"))

    lags = F.sequence(F.lit(1), F.size("r") - 1)
    folded = r.filter(F.size("r") > 1).select("symbol", F.aggregate(lags, start, step)["out"].alias("_out"))
    return folded.select("symbol", F.posexplode("_out").alias("lag", "pacf"))


def seasonal_decompose(
    bars: DataFrame, c: str = "close", period: int = TRADING_DAYS, multiplicative: bool = True, size: int = BLOCK_ROWS
) -> DataFrame:
    """Trend, seasonal factor and residual per row.

    The trend is a centred moving average (half weight on both ends of an even period), the seasonal
    factor the mean detrended value per phase, normalised over the period.
    """
    half = period // 2

    def build(df, w):
        full = w.rowsBetween(-half, half)
        total = F.sum(c).over(full)
        if period % 2 == 0:
            ends = F.first(c).over(full) + F.last(c).over(full)
            total = total - 0.5 * ends
        return df.withColumn("trend", F.when(F.count(c).over(full) == 2 * half + 1, total / period))

    rows = number_rows(bars.select("symbol", "date", c))
    trend = windowed(rows, build, before=half, after=half, size=size, keep=("_rn",)).withColumn("_phase", F.col("_rn") % period)
    detrended = ratio(c, "trend") if multiplicative else F.col(c) - F.col("trend")
    phases = trend.groupBy("symbol", "_phase").agg(F.avg(detrended).alias("_mean"))
    overall = F.avg("_mean").over(Window.partitionBy("symbol"))
    factor = ratio("_mean", overall) if multiplicative else F.col("_mean") - overall
    seasonal = phases.select("symbol", "_phase", factor.alias("seasonal"))
    out = attach(trend, seasonal, ["symbol", "_phase"])
    residual = ratio(c, F.col("seasonal") * F.col("trend")) if multiplicative else F.col(c) - F.col("seasonal") - F.col("trend")
    return out.select("symbol", "date", c, "trend", "seasonal", residual.alias("resid"))
