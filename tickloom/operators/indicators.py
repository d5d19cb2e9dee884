"""Technical indicators as DataFrame operators: each adds its columns for every symbol at once."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import rolling as R
from tickloom.functions.scalar import ratio
from tickloom.operators.averages import with_averages
from tickloom.operators.recurrences import State, with_state
from tickloom.operators.series import attach, forward_fill, running_max, windowed

TRADING_DAYS = 252


def add(df: DataFrame, columns: Callable[[WindowSpec], dict[str, Column]], before: int = 0, after: int = 0) -> DataFrame:
    """Add window columns that reach a bounded number of rows back or ahead."""
    return windowed(df, lambda d, w: d.withColumns(columns(w)), before=before, after=after)


def log_returns(bars: DataFrame, column: str = "close", out: str = "log_return") -> DataFrame:
    return add(bars, lambda w: {out: R.log_return(column, w)}, before=1)


def ema(bars: DataFrame, spans: Sequence[int], column: str = "close") -> DataFrame:
    """One ``ema_<span>`` column per span. A NULL value is an error: ``ffill`` first."""
    if not _daily(bars):
        return with_averages(bars, {f"ema_{s}": (column, s) for s in spans})
    same = {f"ema_{s}": F.col(column).cast("double") for s in spans if s == 1}
    state = State({f"ema_{s}": (column, s) for s in spans if s > 1})
    return with_state(bars, state).drop("_rn").withColumns(same).select(*bars.columns, *[f"ema_{s}" for s in spans])


def _daily(bars: DataFrame, order: str = "date") -> bool:
    return isinstance(bars.schema[order].dataType, T.DateType)


def rsi_value(flat: float | None = 100.0) -> Column:
    """RSI from the averages ``_g`` and ``_l``; ``flat`` is the value where prices neither rose nor fell so far."""
    return (
        F.when((F.col("_l") == 0) & (F.col("_g") == 0), F.lit(flat).cast("double"))
        .when(F.col("_l") == 0, F.lit(100.0))
        .otherwise(100 - 100 / (1 + ratio("_g", "_l")))
    )


def oscillator_state(rsi_span: int | None = 14, macd_spans: tuple[int, int, int] | None = (12, 26, 9), obv: bool = False) -> State:
    """What RSI, MACD and on-balance volume carry from day to day."""
    if macd_spans is None:
        return State(moves=rsi_span, obv=obv)
    fast, slow, signal = macd_spans
    return State({"_fast": ("close", fast), "_slow": ("close", slow)}, ("MACD_Signal", "_fast", "_slow", signal), rsi_span, obv)


def oscillator_columns(state: State, flat: float | None = 100.0) -> dict[str, Column]:
    """RSI and MACD columns from the values of the state."""
    line = F.col("_fast") - F.col("_slow")
    macd_columns = {"MACD_Line": line, "MACD_Histogram": line - F.col("MACD_Signal")} if state.signal else {}
    return macd_columns | ({"RSI_14": rsi_value(flat)} if state.moves else {})


def oscillators(
    bars: DataFrame, rsi_span: int | None = 14, macd_spans: tuple[int, int, int] | None = (12, 26, 9), flat: float | None = 100.0, keep: Sequence[str] = ()
) -> DataFrame:
    """RSI and MACD columns, each over the whole history of its daily series, in one pass over the bars."""
    state = oscillator_state(rsi_span, macd_spans)
    out = with_state(bars, state).withColumns(oscillator_columns(state, flat))
    return out.drop(*({"_g", "_l", "_fast", "_slow", "_rn"} - set(keep)))


def rsi(bars: DataFrame, span: int = 14) -> DataFrame:
    return oscillators(bars, rsi_span=span, macd_spans=None)


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return oscillators(bars, rsi_span=None, macd_spans=(fast, slow, signal))


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    def columns(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = df.withColumns({"_mid": R.sma("close", n, w), "_dev": R.rolling_std("close", n, w)})
        upper, lower = F.col("_mid") + k * F.col("_dev"), F.col("_mid") - k * F.col("_dev")
        return df.withColumns(
            {"bollinger_upper": upper, "bollinger_lower": lower, "bollinger_width": ratio(upper - lower, "_mid")}
        ).drop("_mid", "_dev")

    return windowed(bars, columns, before=n - 1)


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    def columns(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = df.withColumn("true_range", R.true_range(w))
        df = df.withColumn("atr", R.sma("true_range", n, w))
        return df.withColumn("atr_pct", ratio("atr", "close"))

    return windowed(bars, columns, before=n)


def obv(bars: DataFrame) -> DataFrame:
    """On-balance volume: the running sum of signed volume."""
    return with_state(bars, State(obv=True)).withColumnRenamed("OBV", "obv").drop("_rn")


def drawdown(bars: DataFrame) -> DataFrame:
    peak = running_max(bars, "close", "running_max")
    return peak.withColumn("drawdown", ratio("close", "running_max") - 1)


def realized_vol(bars: DataFrame, n: int = 30, periods: int = TRADING_DAYS) -> DataFrame:
    def columns(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = df.withColumn("_r", R.log_return("close", w))
        return df.withColumn("realized_vol", R.rolling_std("_r", n, w) * math.sqrt(periods)).drop("_r")

    return windowed(bars, columns, before=n)


def base_100(bars: DataFrame) -> DataFrame:
    """Close relative to the first close of the symbol, times 100.  The first close comes from an aggregate, not a window."""
    first = bars.filter("close IS NOT NULL").groupBy("symbol").agg(F.min_by("close", "date").alias("_first"))
    return attach(bars, first, how="left").withColumn("base_100", ratio("close", "_first") * 100).drop("_first")


def ffill(bars: DataFrame, columns: Sequence[str]) -> DataFrame:
    return forward_fill(bars, columns)


def sma_crossover(bars: DataFrame, fast: int = 20, slow: int = 50) -> DataFrame:
    """Days on which the fast average crosses the slow one: +1 upwards, -1 downwards."""

    def columns(df: DataFrame, w: WindowSpec) -> DataFrame:
        df = df.withColumn("_side", F.signum(R.sma("close", fast, w) - R.sma("close", slow, w)))
        return df.withColumn("_before", F.lag("_side", 1).over(w))

    crossed = windowed(bars, columns, before=slow).filter((F.col("_side") != F.col("_before")) & (F.col("_side") != 0))
    return crossed.withColumn("crossover", F.col("_side").cast("int")).drop("_side", "_before")


def regime_flags(bars: DataFrame) -> DataFrame:
    """RSI band, sign of the MACD histogram and volume shock as labels."""

    def columns(df: DataFrame, w: WindowSpec) -> DataFrame:
        shock = ratio("volume", R.sma("volume", 10, w))
        return df.withColumns(
            {
                "rsi_band": F.when(F.col("RSI_14") > 70, "overbought").when(F.col("RSI_14") < 30, "oversold").otherwise("neutral"),
                "macd_side": F.when(F.col("MACD_Histogram") >= 0, "up").otherwise("down"),
                "volume_shock_flag": F.coalesce(shock > 1.5, F.lit(False)),
            }
        )

    return windowed(oscillators(bars, keep=["_rn"]), columns, before=10)
