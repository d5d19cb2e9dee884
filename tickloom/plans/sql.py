"""Building blocks of the comparison SQL: views over the test tables and the feature table."""

from __future__ import annotations

import math

BARS = """bars AS (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date,
         min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close,
         CAST(sum(o_orderkey % 997 + 1) AS BIGINT) AS volume
  FROM orders GROUP BY ALL)"""

MACRO = """macro AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
         CASE l_returnflag WHEN 'A' THEN 'SP500' WHEN 'N' THEN 'VIX' ELSE 'EURUSD' END AS series,
         avg(l_extendedprice) AS close
  FROM lineitem GROUP BY ALL)"""

MACRO_WIDE = (
    MACRO
    + """, macro_wide AS (
  SELECT date, max(CASE WHEN series = 'SP500' THEN close END) AS SP500_Close,
         max(CASE WHEN series = 'VIX' THEN close END) AS VIX_Close,
         max(CASE WHEN series = 'EURUSD' THEN close END) AS EURUSD_Close
  FROM macro GROUP BY date)"""
)

MACRO_RETURNS = (
    MACRO_WIDE
    + """, macro_returns AS (
  SELECT date, coalesce(ln(SP500_Close / lag(SP500_Close) OVER (ORDER BY date)), 0) AS SP500_Return,
         coalesce(ln(VIX_Close / lag(VIX_Close) OVER (ORDER BY date)), 0) AS VIX_Return,
         coalesce(ln(EURUSD_Close / lag(EURUSD_Close) OVER (ORDER BY date)), 0) AS EURUSD_Return
  FROM macro_wide)"""
)

SCORED = """scored AS (
  SELECT o_orderpriority AS symbol, CAST(l_shipdate AS DATE) AS date, l_discount * 10 - l_tax * 10 AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 2)"""

SENTIMENT = (
    SCORED
    + """, sentiment AS (
  SELECT symbol, date, avg(score) AS sentiment_score FROM scored GROUP BY ALL)"""
)

LOGS = """logs AS (
  SELECT event_type AS symbol, event_id, ts, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k,
         CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'reference' ELSE 'current' END AS side
  FROM events)"""

LOGS_LONG = (
    LOGS
    + """, long AS (
  SELECT symbol, 'value' AS feature, side, value FROM logs
  UNION ALL SELECT symbol, 'k', side, k FROM logs)"""
)

W = "OVER (PARTITION BY symbol ORDER BY date)"


def r(expression: str, digits: int) -> str:
    return f"round({expression}, {digits}) + 0.0"


def frame(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rolling(function: str, column: str, n: int) -> str:
    return f"CASE WHEN count({column}) {frame(n)} = {n} THEN {function}({column}) {frame(n)} END"


def ema(column: str, span: int) -> str:
    """Over the whole history: the list of all values so far, reduced in order."""
    a = 2 / (span + 1)
    return f"list_reduce(list({column}) {W}, lambda acc, x: {1 - a!r} * acc + {a!r} * x)"


def with_(*ctes: str) -> str:
    """WITH clause of the CTE lists, in order, each name once."""
    return "WITH " + ", ".join(ctes) + " "


def features(source: str = "bars", join: bool = True) -> str:
    """CTEs up to ``feat``: all features of ``source``, incomplete rows included."""
    macro = (
        """SELECT b.*, coalesce(m.SP500_Return, 0) AS SP500_Return, coalesce(m.VIX_Return, 0) AS VIX_Return,
         coalesce(m.EURUSD_Return, 0) AS EURUSD_Return, coalesce(s.sentiment_score, 0) AS Sentiment_Score
  FROM {0} b LEFT JOIN macro_returns m ON b.date = m.date
       LEFT JOIN sentiment s ON b.symbol = s.symbol AND b.date = s.date"""
        if join
        else "SELECT b.* FROM {0} b"
    ).format(source)
    pi2 = repr(2 * math.pi)
    extra = "SP500_Return, VIX_Return, EURUSD_Return, Sentiment_Score, " if join else ""
    return f"""f0 AS ({macro}),
f1 AS (SELECT *, lag(close) {W} AS prev FROM f0),
f2 AS (SELECT *, ln(close / nullif(prev, 0)) AS lr, row_number() {W} AS rn,
       CASE WHEN close > prev THEN volume WHEN close < prev THEN -volume ELSE 0 END AS signed,
       CASE WHEN close > prev THEN close - prev ELSE 0 END AS gain,
       CASE WHEN close < prev THEN prev - close ELSE 0 END AS loss,
       greatest(high - low, abs(high - prev), abs(low - prev)) AS tr FROM f1),
f3 AS (SELECT *, lead(lr) {W} AS target, lag(lr, 1) {W} AS lag1, lag(lr, 2) {W} AS lag2, lag(lr, 3) {W} AS lag3,
       lag(lr, 5) {W} AS lag5, {rolling("avg", "close", 20)} AS sma20, {rolling("avg", "close", 50)} AS sma50,
       {rolling("stddev_samp", "close", 20)} AS std20, {rolling("stddev_samp", "lr", 14)} AS std14,
       {rolling("avg", "volume", 10)} AS vol10, {rolling("avg", "tr", 14)} AS atr,
       lag(volume, 5) {W} AS volume5, CAST(sum(signed) {W} AS BIGINT) AS obv,
       {ema("gain", 14)} AS g, {ema("loss", 14)} AS l, {ema("close", 12)} - {ema("close", 26)} AS macd FROM f2),
f4 AS (SELECT *, lag(obv, 5) {W} AS obv5, {ema("macd", 9)} AS signal FROM f3),
feat AS (SELECT symbol, date, close, volume, obv AS OBV, rn, {extra}lr AS Log_Return, lag1 AS Lag_1, lag2 AS Lag_2, lag3 AS Lag_3,
       lag5 AS Lag_5, std14 AS Rolling_Std_14, close / sma20 - 1 AS Distancia_SMA_20, close / sma50 - 1 AS Distancia_SMA_50,
       4 * std20 / sma20 AS Bollinger_Width, volume / nullif(vol10, 0) AS Volume_Shock,
       sin({pi2} * month(date) / 12) AS Month_Sin, cos({pi2} * month(date) / 12) AS Month_Cos,
       sin({pi2} * (isodow(date) - 1) / 5) AS Day_Sin, cos({pi2} * (isodow(date) - 1) / 5) AS Day_Cos,
       volume / nullif(volume5, 0) - 1 AS Volume_ROC_5, obv / nullif(obv5, 0) - 1 AS OBV_ROC_5,
       CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END AS RSI_14, macd AS MACD_Line, signal AS MACD_Signal,
       macd - signal AS MACD_Histogram, atr AS ATR_14, atr / nullif(close, 0) AS ATR_Pct, target AS Target_Log_Return
       FROM f4)"""


FEATURE_CTES = ", ".join([BARS, MACRO_RETURNS, SENTIMENT, features()])
TECHNICAL_CTES = ", ".join([BARS, features(join=False)])


def complete(columns: list[str]) -> str:
    return " AND ".join(f"{c} IS NOT NULL" for c in columns)
