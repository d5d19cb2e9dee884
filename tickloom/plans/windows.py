"""Queries over time-ordered windows: returns, averages, oscillators, running values, calendar fill."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.functions.scalar import calendar_features, candle_color, month_of, ratio, weekday_of
from tickloom.operators import bars as B
from tickloom.operators import indicators as I
from tickloom.plans import sql as S
from tickloom.plans.registry import query, show
from tickloom.plans.sql import W, r
from tickloom.sources import views

BARS = f"WITH {S.BARS}"
RETURNS = f"{BARS}, ret AS (SELECT *, ln(close / nullif(lag(close) {W}, 0)) AS lr FROM bars)"


@query("log_return", f"{RETURNS} SELECT symbol, date, {r('lr', 6)} AS log_return FROM ret")
def log_return(spark: SparkSession, sf: str) -> DataFrame:
    return show(I.log_returns(views.bars(spark, sf)), "symbol", "date", log_return=6)


@query(
    "return_lags",
    f"{RETURNS} SELECT symbol, date, "
    + ", ".join(f"{r(f'lag(lr, {k}) {W}', 6)} AS Lag_{k}" for k in (1, 2, 3, 5))
    + " FROM ret",
)
def return_lags(spark: SparkSession, sf: str) -> DataFrame:
    def columns(df, w):
        df = df.withColumn("lr", R.log_return("close", w))
        return df.withColumns(R.lags("lr", [1, 2, 3, 5], w))

    out = I.windowed(views.bars(spark, sf), columns, before=6)
    return show(out, "symbol", "date", Lag_1=6, Lag_2=6, Lag_3=6, Lag_5=6)


@query("target_next_return", f"{RETURNS} SELECT symbol, date, {r(f'lead(lr) {W}', 6)} AS target FROM ret")
def target_next_return(spark: SparkSession, sf: str) -> DataFrame:
    def columns(df, w):
        return df.withColumn("lr", R.log_return("close", w)).withColumn("target", F.lead("lr", 1).over(w))

    return show(I.windowed(views.bars(spark, sf), columns, before=1, after=1), "symbol", "date", target=6)


@query("pct_change", f"{BARS} SELECT symbol, date, {r(f'(close / nullif(lag(close) {W}, 0) - 1) * 100', 5)} AS pct FROM bars")
def pct_change(spark: SparkSession, sf: str) -> DataFrame:
    out = I.add(views.bars(spark, sf), lambda w: {"pct": R.pct_change("close", 1, w) * 100}, before=1)
    return show(out, "symbol", "date", pct=5)


@query(
    "macro_returns",
    f"WITH {S.MACRO_RETURNS} SELECT date, {r('SP500_Return', 6)} AS SP500_Return, {r('VIX_Return', 6)} AS VIX_Return, "
    f"{r('EURUSD_Return', 6)} AS EURUSD_Return FROM macro_returns",
)
def macro_returns(spark: SparkSession, sf: str) -> DataFrame:
    return show(B.macro_returns(views.macro_long(spark, sf)), "date", SP500_Return=6, VIX_Return=6, EURUSD_Return=6)


SPANS = (20, 50, 90)


@query(
    "sma",
    f"{BARS} SELECT symbol, date, " + ", ".join(f"{r(S.rolling('avg', 'close', n), 4)} AS sma_{n}" for n in SPANS) + " FROM bars",
)
def sma(spark: SparkSession, sf: str) -> DataFrame:
    out = I.add(views.bars(spark, sf), lambda w: {f"sma_{n}": R.sma("close", n, w) for n in SPANS}, before=89)
    return show(out, "symbol", "date", sma_20=4, sma_50=4, sma_90=4)


@query(
    "rolling_std",
    f"{RETURNS} SELECT symbol, date, {r(S.rolling('stddev_samp', 'close', 20), 4)} AS std_20, "
    f"{r(S.rolling('stddev_samp', 'lr', 14), 6)} AS std_14, {r(S.rolling('stddev_samp', 'lr', 30), 6)} AS std_30 FROM ret",
)
def rolling_std(spark: SparkSession, sf: str) -> DataFrame:
    def columns(df, w):
        df = df.withColumn("lr", R.log_return("close", w))
        return df.withColumns(
            {
                "std_20": R.rolling_std("close", 20, w),
                "std_14": R.rolling_std("lr", 14, w),
                "std_30": R.rolling_std("lr", 30, w),
            }
        )

    return show(I.windowed(views.bars(spark, sf), columns, before=30), "symbol", "date", std_20=4, std_14=6, std_30=6)


@query(
    "volume_shock",
    f"{BARS}, v AS (SELECT *, {S.rolling('avg', 'volume', 10)} AS sma FROM bars) "
    f"SELECT symbol, date, {r('sma', 4)} AS volume_sma_10, {r('volume / nullif(sma, 0)', 6)} AS shock FROM v",
)
def volume_shock(spark: SparkSession, sf: str) -> DataFrame:
    out = I.add(views.bars(spark, sf), lambda w: {"volume_sma_10": R.sma("volume", 10, w)}, before=9)
    return show(out.withColumn("shock", ratio("volume", "volume_sma_10")), "symbol", "date", volume_sma_10=4, shock=6)


@query(
    "sma_distance",
    f"{BARS} SELECT symbol, date, "
    + ", ".join(f"{r('close / ' + '(' + S.rolling('avg', 'close', n) + ') - 1', 6)} AS distance_{n}" for n in (9, 20, 21, 50))
    + " FROM bars",
)
def sma_distance(spark: SparkSession, sf: str) -> DataFrame:
    ns = (9, 20, 21, 50)
    out = I.add(
        views.bars(spark, sf), lambda w: {f"distance_{n}": ratio("close", R.sma("close", n, w)) - 1 for n in ns}, before=49
    )
    return show(out, "symbol", "date", distance_9=6, distance_20=6, distance_21=6, distance_50=6)


@query(
    "bollinger",
    f"{BARS}, m AS (SELECT *, {S.rolling('avg', 'close', 20)} AS mid, {S.rolling('stddev_samp', 'close', 20)} AS dev FROM bars) "
    f"SELECT symbol, date, {r('mid + 2 * dev', 4)} AS bollinger_upper, {r('mid - 2 * dev', 4)} AS bollinger_lower, "
    f"{r('4 * dev / mid', 6)} AS bollinger_width FROM m",
)
def bollinger(spark: SparkSession, sf: str) -> DataFrame:
    out = I.bollinger(views.bars(spark, sf))
    return show(out, "symbol", "date", bollinger_upper=4, bollinger_lower=4, bollinger_width=6)


OBV_SQL = (
    f"{BARS}, p AS (SELECT *, lag(close) {W} AS prev FROM bars), "
    "s AS (SELECT *, CASE WHEN close > prev THEN volume WHEN close < prev THEN -volume ELSE 0 END AS signed FROM p), "
    f"o AS (SELECT *, CAST(sum(signed) {W} AS BIGINT) AS obv FROM s) "
)


@query("obv", f"{OBV_SQL} SELECT symbol, date, obv FROM o")
def obv(spark: SparkSession, sf: str) -> DataFrame:
    return I.obv(views.bars(spark, sf)).select("symbol", "date", "obv")


@query(
    "roc_5",
    f"{OBV_SQL} SELECT symbol, date, {r(f'volume / nullif(lag(volume, 5) {W}, 0) - 1', 6)} AS volume_roc_5, "
    f"{r(f'obv / nullif(lag(obv, 5) {W}, 0) - 1', 4)} AS obv_roc_5 FROM o",
)
def roc_5(spark: SparkSession, sf: str) -> DataFrame:
    out = I.add(
        I.obv(views.bars(spark, sf)),
        lambda w: {"volume_roc_5": R.pct_change("volume", 5, w), "obv_roc_5": R.pct_change("obv", 5, w)},
        before=5,
    )
    return show(out, "symbol", "date", volume_roc_5=6, obv_roc_5=4)


@query(
    "ema",
    f"{BARS} SELECT symbol, date, " + ", ".join(f"{r(S.ema('close', n), 3)} AS ema_{n}" for n in (9, 12, 26)) + " FROM bars",
)
def ema(spark: SparkSession, sf: str) -> DataFrame:
    return show(I.ema(views.bars(spark, sf), [9, 12, 26]), "symbol", "date", ema_9=3, ema_12=3, ema_26=3)


@query("rsi_14", f"WITH {S.TECHNICAL_CTES} SELECT symbol, date, {r('RSI_14', 5)} AS rsi_14 FROM feat")
def rsi_14(spark: SparkSession, sf: str) -> DataFrame:
    return show(I.rsi(views.bars(spark, sf)).withColumnRenamed("RSI_14", "rsi_14"), "symbol", "date", rsi_14=5)


@query(
    "macd",
    f"WITH {S.TECHNICAL_CTES} SELECT symbol, date, {r('MACD_Line', 3)} AS macd_line, {r('MACD_Signal', 3)} AS macd_signal, "
    f"{r('MACD_Histogram', 3)} AS macd_histogram FROM feat",
)
def macd(spark: SparkSession, sf: str) -> DataFrame:
    out = I.macd(views.bars(spark, sf)).withColumnsRenamed(
        {"MACD_Line": "macd_line", "MACD_Signal": "macd_signal", "MACD_Histogram": "macd_histogram"}
    )
    return show(out, "symbol", "date", macd_line=3, macd_signal=3, macd_histogram=3)


DRAWDOWN_SQL = f"{BARS}, d AS (SELECT *, max(close) {W} AS running_max FROM bars)"


@query("drawdown", f"{DRAWDOWN_SQL} SELECT symbol, date, running_max, {r('close / running_max - 1', 6)} AS drawdown FROM d")
def drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return show(I.drawdown(views.bars(spark, sf)), "symbol", "date", "running_max", drawdown=6)


@query("max_drawdown", f"{DRAWDOWN_SQL} SELECT symbol, {r('min(close / running_max - 1)', 6)} AS max_drawdown FROM d GROUP BY symbol")
def max_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    out = I.drawdown(views.bars(spark, sf)).groupBy("symbol").agg(F.min("drawdown").alias("max_drawdown"))
    return show(out, "symbol", max_drawdown=6)


@query(
    "ffill",
    f"{BARS}, h AS (SELECT symbol, date, CASE WHEN day(date) % 7 = 0 THEN close END AS close, "
    "CASE WHEN day(date) % 5 = 0 THEN volume END AS volume FROM bars) "
    "SELECT symbol, date, last_value(close IGNORE NULLS) OVER w AS close, last_value(volume IGNORE NULLS) OVER w AS volume FROM h "
    "WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
def ffill(spark: SparkSession, sf: str) -> DataFrame:
    holes = views.bars(spark, sf).select(
        "symbol",
        "date",
        F.when(F.dayofmonth("date") % 7 == 0, F.col("close")).alias("close"),
        F.when(F.dayofmonth("date") % 5 == 0, F.col("volume")).alias("volume"),
    )
    return I.ffill(holes, ["close", "volume"])


@query(
    "resample_daily_ffill",
    f"{BARS}, span AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM bars GROUP BY symbol), "
    "days AS (SELECT symbol, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span) "
    "SELECT d.symbol, d.date, b.close FROM days d ASOF JOIN bars b ON d.symbol = b.symbol AND d.date >= b.date",
)
def resample_daily_ffill(spark: SparkSession, sf: str) -> DataFrame:
    return B.fill_calendar(views.bars(spark, sf), ["close"])


TR_SQL = (
    f"{BARS}, p AS (SELECT *, lag(close) {W} AS prev FROM bars), "
    "t AS (SELECT *, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr FROM p)"
)


@query("true_range", f"{TR_SQL} SELECT symbol, date, {r('tr', 4)} AS true_range FROM t")
def true_range(spark: SparkSession, sf: str) -> DataFrame:
    out = I.add(views.bars(spark, sf), lambda w: {"true_range": R.true_range(w)}, before=1)
    return show(out, "symbol", "date", true_range=4)


@query(
    "atr_14",
    f"{TR_SQL}, a AS (SELECT *, {S.rolling('avg', 'tr', 14)} AS atr FROM t) "
    f"SELECT symbol, date, {r('atr', 3)} AS atr, {r('atr / nullif(close, 0)', 6)} AS atr_pct FROM a",
)
def atr_14(spark: SparkSession, sf: str) -> DataFrame:
    return show(I.atr(views.bars(spark, sf)), "symbol", "date", atr=3, atr_pct=6)


@query(
    "realized_vol_30",
    f"{RETURNS} SELECT symbol, date, {r('(' + S.rolling('stddev_samp', 'lr', 30) + ') * sqrt(252)', 5)} AS realized_vol FROM ret",
)
def realized_vol_30(spark: SparkSession, sf: str) -> DataFrame:
    return show(I.realized_vol(views.bars(spark, sf)), "symbol", "date", realized_vol=5)


@query(
    "base_100",
    f"{BARS} SELECT symbol, date, {r(f'close / first_value(close) {W} * 100', 5)} AS base_100 FROM bars",
)
def base_100(spark: SparkSession, sf: str) -> DataFrame:
    return show(I.base_100(views.bars(spark, sf)), "symbol", "date", base_100=5)


@query(
    "sma_crossover",
    f"{BARS}, m AS (SELECT *, sign({S.rolling('avg', 'close', 20)} - {S.rolling('avg', 'close', 50)}) AS side FROM bars), "
    f"c AS (SELECT *, lag(side) {W} AS before FROM m) "
    "SELECT symbol, date, CAST(side AS INTEGER) AS crossover FROM c WHERE side <> before AND side <> 0",
)
def sma_crossover(spark: SparkSession, sf: str) -> DataFrame:
    return I.sma_crossover(views.bars(spark, sf)).select("symbol", "date", "crossover")


@query("candle_color", f"{BARS} SELECT symbol, date, CASE WHEN close < open THEN 'red' ELSE 'green' END AS color FROM bars")
def candle_color_query(spark: SparkSession, sf: str) -> DataFrame:
    return views.bars(spark, sf).select("symbol", "date", candle_color().alias("color"))


@query(
    "regime_flags",
    f"WITH {S.TECHNICAL_CTES} SELECT symbol, date, CASE WHEN RSI_14 > 70 THEN 'overbought' WHEN RSI_14 < 30 THEN 'oversold' "
    "ELSE 'neutral' END AS rsi_band, CASE WHEN MACD_Histogram >= 0 THEN 'up' ELSE 'down' END AS macd_side, "
    "coalesce(Volume_Shock > 1.5, false) AS volume_shock_flag FROM feat",
)
def regime_flags(spark: SparkSession, sf: str) -> DataFrame:
    return I.regime_flags(views.bars(spark, sf)).select("symbol", "date", "rsi_band", "macd_side", "volume_shock_flag")


@query(
    "calendar_parts",
    "SELECT o_orderkey AS id, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday FROM orders",
)
def calendar_parts(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), month_of("o_orderdate").alias("month"), weekday_of("o_orderdate").alias("weekday")
    )


@query(
    "cyclic_calendar",
    f"{BARS} SELECT symbol, date, {r('sin(2 * pi() * month(date) / 12)', 6)} AS Month_Sin, {r('cos(2 * pi() * month(date) / 12)', 6)} AS Month_Cos, "
    f"{r('sin(2 * pi() * (isodow(date) - 1) / 5)', 6)} AS Day_Sin, {r('cos(2 * pi() * (isodow(date) - 1) / 5)', 6)} AS Day_Cos FROM bars",
)
def cyclic_calendar(spark: SparkSession, sf: str) -> DataFrame:
    out = views.bars(spark, sf).withColumns(calendar_features("date"))
    return show(out, "symbol", "date", Month_Sin=6, Month_Cos=6, Day_Sin=6, Day_Cos=6)
