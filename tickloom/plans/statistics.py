"""Queries of the exploratory statistics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.functions.scalar import month_of, weekday_of
from tickloom.operators import features as FT
from tickloom.operators import news as N
from tickloom.operators import sketches as SK
from tickloom.operators import stats as ST
from tickloom.operators.series import windowed
from tickloom.plans import sql as S
from tickloom.plans.feature_tables import EDA_COLUMNS
from tickloom.plans.registry import query, show
from tickloom.plans.sql import W, r
from tickloom.plans.windows import BARS, RETURNS
from tickloom.schemas import TARGET
from tickloom.sources import views

RET = f"{RETURNS}, rets AS (SELECT * FROM ret WHERE lr IS NOT NULL)"
SYMBOLS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
CORR = "covar_pop({0}, {1}) / nullif(stddev_pop({0}) * stddev_pop({1}), 0)"


@query(
    "ticker_inventory",
    f"{BARS} SELECT symbol, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, "
    "(count(*) * 5 - count(open) - count(high) - count(low) - count(close) - count(volume)) * 20.0::DOUBLE / count(*) AS null_pct, "
    "min(close) AS close_min, max(close) AS close_max, max_by(close, date) AS close_last FROM bars GROUP BY symbol",
)
def ticker_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return ST.ticker_inventory(views.bars(spark, sf))


PROFILE_TYPES = {"symbol": "string", "date": "date", "open": "double", "high": "double", "low": "double", "close": "double",
                 "volume": "bigint", "ret": "double"}


@query(
    "column_profile",
    f"{BARS}, p AS (SELECT *, close / lag(close) {W} - 1 AS ret FROM bars), c AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null, count(*) AS n FROM p"
        for c, t in PROFILE_TYPES.items()
    )
    + f") SELECT column_name, data_type, non_null, n - non_null AS nulls, {r('(n - non_null) * 100.0::DOUBLE / n', 6)} AS null_pct FROM c",
)
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    b = windowed(views.bars(spark, sf), lambda d, w: d.withColumn("ret", R.pct_change("close", 1, w)), before=1)
    return show(ST.profile(b.select(*PROFILE_TYPES)), "column_name", "data_type", "non_null", "nulls", null_pct=6)


@query(
    "return_stats",
    f"{RET}, m AS (SELECT symbol, avg(lr) AS mu, stddev_samp(lr) AS sd, stddev_pop(lr) AS sp, min(lr) AS lo, max(lr) AS hi FROM rets "
    "GROUP BY symbol), k AS (SELECT symbol, avg(power((lr - mu) / sp, 3)) AS skew, avg(power((lr - mu) / sp, 4)) - 3 AS kurt "
    "FROM rets JOIN m USING (symbol) GROUP BY symbol) "
    f"SELECT symbol, {r('mu', 6)} AS mean, {r('sd', 6)} AS std, {r('lo', 6)} AS min, {r('hi', 6)} AS max, {r('skew', 5)} AS skewness, "
    f"{r('kurt', 5)} AS kurtosis, {r('mu / sd * sqrt(252)', 5)} AS sharpe FROM m JOIN k USING (symbol)",
)
def return_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = ST.return_stats(ST.with_return(views.bars(spark, sf)))
    return show(out, "symbol", mean=6, std=6, min=6, max=6, skewness=5, kurtosis=5, sharpe=5)


@query(
    "seasonality_weekday",
    f"{RET} SELECT symbol, CAST(isodow(date) - 1 AS INTEGER) AS weekday, {r('avg(lr) * 100', 5)} AS mean_return_pct FROM rets GROUP BY ALL",
)
def seasonality_weekday(spark: SparkSession, sf: str) -> DataFrame:
    out = ST.seasonality(ST.with_return(views.bars(spark, sf)), weekday_of("date"), "weekday")
    return show(out, "symbol", "weekday", mean_return_pct=5)


@query(
    "seasonality_month",
    f"{RET} SELECT symbol, CAST(month(date) AS INTEGER) AS month, {r('avg(lr) * 100', 5)} AS mean_return_pct FROM rets GROUP BY ALL",
)
def seasonality_month(spark: SparkSession, sf: str) -> DataFrame:
    out = ST.seasonality(ST.with_return(views.bars(spark, sf)), month_of("date"), "month")
    return show(out, "symbol", "month", mean_return_pct=5)


@query(
    "volume_clip_q99",
    f"{BARS}, q AS (SELECT symbol, quantile_cont(CAST(volume AS DOUBLE), 0.99) AS top FROM bars GROUP BY symbol) "
    f"SELECT symbol, date, volume, {r('least(greatest(volume, 0), top)', 4)} AS volume_clipped FROM bars JOIN q USING (symbol)",
)
def volume_clip_q99(spark: SparkSession, sf: str) -> DataFrame:
    return show(ST.clip_quantile(views.bars(spark, sf)), "symbol", "date", "volume", volume_clipped=4)


@query("volume_clip_sketch", f"{BARS} SELECT symbol, count(*) AS n, true AS in_bound FROM bars GROUP BY symbol")
def volume_clip_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """The clip at an approximate quantile: the exact share of volumes up to it is 0.99 within the sketch's error and one row."""
    clipped = SK.clip_quantile(views.bars(spark, sf).select("symbol", "date", "volume"))
    one = clipped.groupBy("symbol").agg(F.count("*").alias("n"), F.avg((F.col("volume") <= F.col("volume_clipped")).cast("double")).alias("share"))
    return one.select("symbol", "n", (F.abs(F.col("share") - 0.99) <= SK.rank_error() + 1 / F.col("n")).alias("in_bound"))


@query(
    "return_histogram",
    f"{RET}, s AS (SELECT symbol, min(lr) AS lo, max(lr) AS hi FROM rets GROUP BY symbol) "
    "SELECT symbol, least(CAST(floor((lr - lo) / nullif(hi - lo, 0) * 120) AS BIGINT), 119) AS bin, count(*) AS n "
    "FROM rets JOIN s USING (symbol) GROUP BY ALL",
)
def return_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return ST.histogram(ST.with_return(views.bars(spark, sf)), "log_return", 120)


CORR_COLUMNS = ["open", "high", "low", "close", "volume", "pct", "ma_20"]


@query(
    "corr_matrix_features",
    f"{BARS}, f AS (SELECT *, (close / nullif(lag(close) {W}, 0) - 1) * 100 AS pct, {S.rolling('avg', 'close', 20)} AS ma_20 FROM bars), "
    "m AS ("
    + " UNION ALL ".join(
        f"SELECT symbol, '{a}' AS a, '{b}' AS b, "
        + CORR.format(
            f"CASE WHEN {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END", f"CASE WHEN {a} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
        )
        + " AS corr FROM f GROUP BY symbol"
        for a in CORR_COLUMNS
        for b in CORR_COLUMNS
    )
    + f") SELECT symbol, a, b, {r('corr', 6)} AS corr FROM m",
)
def corr_matrix_features(spark: SparkSession, sf: str) -> DataFrame:
    f = windowed(
        views.bars(spark, sf),
        lambda d, w: d.withColumns({"pct": R.pct_change("close", 1, w) * 100, "ma_20": R.sma("close", 20, w)}),
        before=19,
    )
    return show(ST.corr_long(f, CORR_COLUMNS, ["symbol"]), "symbol", "a", "b", corr=6)


WIDE = f"{RET}, wide AS (SELECT date, " + ", ".join(f"max(CASE WHEN symbol = '{s}' THEN lr END) AS \"{s}\"" for s in SYMBOLS)
WIDE += " FROM rets GROUP BY date), aligned AS (SELECT * FROM wide WHERE " + " AND ".join(f'"{s}" IS NOT NULL' for s in SYMBOLS) + ")"


@query("returns_aligned", f"{WIDE} SELECT date, " + ", ".join(f'{r(chr(34) + s + chr(34), 6)} AS "{s}"' for s in SYMBOLS) + " FROM aligned")
def returns_aligned(spark: SparkSession, sf: str) -> DataFrame:
    out = ST.returns_aligned(ST.with_return(views.bars(spark, sf)), SYMBOLS)
    return show(out, "date", **dict.fromkeys(SYMBOLS, 6))


@query(
    "corr_cross_asset",
    f"{WIDE}, m AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, " + CORR.format(f'"{a}"', f'"{b}"') + " AS corr FROM aligned"
        for i, a in enumerate(SYMBOLS)
        for b in SYMBOLS[:i]
    )
    + f") SELECT a, b, {r('corr', 6)} AS corr FROM m",
)
def corr_cross_asset(spark: SparkSession, sf: str) -> DataFrame:
    wide = ST.returns_aligned(ST.with_return(views.bars(spark, sf)), SYMBOLS)
    return show(ST.corr_long(wide, SYMBOLS, lower_only=True), "a", "b", corr=6)


@query(
    "corr_with_target",
    f"WITH {S.TECHNICAL_CTES}, clean AS (SELECT * FROM feat WHERE {S.complete([*EDA_COLUMNS, TARGET])}), m AS ("
    + " UNION ALL ".join(
        f"SELECT symbol, '{c}' AS feature, {CORR.format(c, TARGET)} AS corr FROM clean GROUP BY symbol" for c in EDA_COLUMNS
    )
    + f") SELECT symbol, feature, {r('corr', 5)} AS corr FROM m",
)
def corr_with_target(spark: SparkSession, sf: str) -> DataFrame:
    out = ST.corr_with_target(FT.eda_features(views.bars(spark, sf)), EDA_COLUMNS, TARGET, ["symbol"])
    return show(out, "symbol", "feature", corr=5)


def acf_sql(x: str) -> str:
    return (
        f"{RETURNS}, x AS (SELECT symbol, date, {x} AS x FROM ret WHERE lr IS NOT NULL), "
        "m AS (SELECT symbol, avg(x) AS mu, count(*) AS n FROM x GROUP BY symbol), "
        "d AS (SELECT symbol, n, x - mu AS d, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM x JOIN m USING (symbol)), "
        "p AS (SELECT a.symbol, a.n, CAST(k.k AS INTEGER) AS lag, sum(a.d * b.d) AS s FROM d a, generate_series(0, 40) k(k), d b "
        "WHERE b.symbol = a.symbol AND b.i = a.i - k.k GROUP BY ALL), "
        "a AS (SELECT p.symbol, p.n, p.lag, p.s / z.s AS acf FROM p JOIN p z ON p.symbol = z.symbol AND z.lag = 0), "
        "b AS (SELECT *, coalesce(sum(CASE WHEN lag > 0 THEN acf * acf END) OVER (PARTITION BY symbol ORDER BY lag "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sq FROM a) "
    )


ACF_SELECT = (
    f"SELECT symbol, lag, {r('acf', 6)} AS acf, "
    f"{r('CASE WHEN lag = 0 THEN 0 ELSE 1.959963984540054 * sqrt((1 + 2 * sq) / n) END', 6)} AS band FROM b"
)


def daily_return(w: WindowSpec) -> Column:
    return R.log_return("close", w)


@query("acf_40", acf_sql("lr") + ACF_SELECT)
def acf_40(spark: SparkSession, sf: str) -> DataFrame:
    return show(ST.acf(views.bars(spark, sf).select("symbol", "date", "close"), value=daily_return), "symbol", "lag", acf=6, band=6)


@query("acf_sq_40", acf_sql("lr * lr") + ACF_SELECT)
def acf_sq_40(spark: SparkSession, sf: str) -> DataFrame:
    closes = views.bars(spark, sf).select("symbol", "date", "close")
    return show(ST.acf(closes, value=lambda w: F.pow(daily_return(w), 2)), "symbol", "lag", acf=6, band=6)


PACF_SQL = (
    acf_sql("lr").replace("WITH ", "WITH RECURSIVE ", 1)
    + ", rs AS (SELECT symbol, list(acf ORDER BY lag) AS r FROM a GROUP BY symbol), "
    "dl AS (SELECT symbol, r, 0 AS k, CAST([] AS DOUBLE[]) AS phi, CAST(1 AS DOUBLE) AS pacf FROM rs UNION ALL "
    "SELECT symbol, r, k + 1, list_concat(list_transform(range(1, k + 1), lambda j: phi[j] - last * phi[k + 1 - j]), [last]), last FROM "
    "(SELECT *, (r[k + 2] - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 2 - j])), 0)) / "
    "(1 - coalesce(list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j + 1])), 0)) AS last FROM dl WHERE k < 40)) "
    f"SELECT symbol, CAST(k AS INTEGER) AS lag, {r('pacf', 6)} AS pacf FROM dl"
)


@query("pacf_40", PACF_SQL)
def pacf_40(spark: SparkSession, sf: str) -> DataFrame:
    closes = views.bars(spark, sf).select("symbol", "date", "close")
    return show(ST.pacf(ST.acf(closes, value=daily_return)), "symbol", "lag", pacf=6)


@query(
    "seasonal_decompose",
    f"{BARS}, span AS (SELECT symbol, min(date) AS lo, max(date) AS hi FROM bars GROUP BY symbol), "
    "days AS (SELECT symbol, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span), "
    "daily AS (SELECT d.symbol, d.date, b.close FROM days d ASOF JOIN bars b ON d.symbol = b.symbol AND d.date >= b.date), "
    f"n AS (SELECT *, row_number() {W} - 1 AS i, CASE WHEN count(*) OVER f = 253 THEN (sum(close) OVER f - 0.5 * (first_value(close) OVER f "
    "+ last_value(close) OVER f)) / 252 END AS trend FROM daily "
    "WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 126 PRECEDING AND 126 FOLLOWING)), "
    "p AS (SELECT symbol, i % 252 AS phase, avg(close / trend) AS m FROM n GROUP BY ALL), "
    "s AS (SELECT symbol, phase, m / avg(m) OVER (PARTITION BY symbol) AS seasonal FROM p) "
    f"SELECT n.symbol, date, {r('trend', 5)} AS trend, {r('seasonal', 6)} AS seasonal, {r('close / (seasonal * trend)', 6)} AS resid "
    "FROM n JOIN s ON n.symbol = s.symbol AND n.i % 252 = s.phase",
)
def seasonal_decompose(spark: SparkSession, sf: str) -> DataFrame:
    from tickloom.operators.bars import fill_calendar

    daily = fill_calendar(views.bars(spark, sf), ["close"])
    return show(ST.seasonal_decompose(daily), "symbol", "date", trend=5, seasonal=6, resid=6)


AS_OF = dt.date(2001, 6, 30)


@query(
    "lookback_days",
    f"{BARS}, s AS (SELECT DISTINCT symbol FROM bars UNION SELECT DISTINCT c_mktsegment FROM customer), "
    "m AS (SELECT symbol, min(date) AS lo FROM bars GROUP BY symbol) "
    "SELECT symbol, CAST(coalesce(date_diff('day', lo, DATE '2001-06-30'), 360) AS INTEGER) AS days FROM s LEFT JOIN m USING (symbol)",
)
def lookback_days(spark: SparkSession, sf: str) -> DataFrame:
    b = views.bars(spark, sf)
    segments = views.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("symbol"))
    return N.lookback_days(b, b.select("symbol").union(segments).distinct(), AS_OF)
