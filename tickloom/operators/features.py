"""The feature table: 26 features and the next-day target per symbol and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.functions.scalar import calendar_features, ratio
from tickloom.operators.bars import join_macro, join_sentiment, macro_range, macro_returns
from tickloom.operators.columns import keep_complete
from tickloom.operators.indicators import oscillator_columns, oscillator_state
from tickloom.operators.recurrences import with_state, with_state_bounded
from tickloom.operators.series import BLOCK_ROWS, windowed
from tickloom.schemas import MACRO_SERIES, TARGET

LAGS = [1, 2, 3, 5]
GROUPS = {
    "macro": list(MACRO_SERIES.values()),
    "sentiment": ["Sentiment_Score"],
    "base": [
        "Log_Return", *[f"Lag_{k}" for k in LAGS], "Rolling_Std_14", "Distancia_SMA_20", "Distancia_SMA_50",
        "Bollinger_Width", "Volume_Shock", "Month_Sin", "Month_Cos", "Day_Sin", "Day_Cos",
    ],
    "roc": ["Volume_ROC_5", "OBV_ROC_5"],
    "rsi": ["RSI_14"],
    "macd": ["MACD_Line", "MACD_Signal", "MACD_Histogram"],
    "macd_hist": ["MACD_Histogram"],
    "atr": ["ATR_14", "ATR_Pct"],
    "levels": ["close", "volume", "OBV"],
}
FULL = ("macro", "sentiment", "base", "roc", "rsi", "macd", "atr")
BASE = ("levels", "base")
OSCILLATORS = ("levels", "base", "rsi", "macd_hist")
EDA = ("base", "roc", "rsi", "macd", "atr")


def columns_of(groups: Sequence[str]) -> list[str]:
    return [c for g in groups for c in GROUPS[g]]


def raw_features(
    bars: DataFrame,
    macro_returns: DataFrame | None = None,
    sentiment: DataFrame | None = None,
    groups: Sequence[str] = FULL,
    rsi_flat: float | None = 100.0,
    size: int = BLOCK_ROWS,
    bounded: bool = False,
) -> DataFrame:
    """(symbol, date, features of ``groups``, target) before incomplete rows are dropped.

    What depends on the whole past (on-balance volume, RSI, MACD) comes with the numbering of the rows, from one pass over them;
    all indicators over a bounded frame then share the blocks of one shuffle.  ``bounded`` says that every symbol has few
    rows, such as a tail, so that a symbol is a block by itself.
    """
    wanted = columns_of(groups)
    joined = bars
    if "macro" in groups:
        zero = {c: F.lit(0.0) for c in GROUPS["macro"]}
        joined = join_macro(joined, macro_returns) if macro_returns is not None else joined.withColumns(zero)
    if "sentiment" in groups:
        no_news = {"Sentiment_Score": F.lit(0.0)}
        joined = join_sentiment(joined, sentiment) if sentiment is not None else joined.withColumns(no_news)

    before = 50
    obv = "OBV" in wanted or "OBV_ROC_5" in wanted
    state = oscillator_state(14 if "rsi" in groups else None, (12, 26, 9) if {"macd", "macd_hist"} & set(groups) else None, obv)

    def build(df: DataFrame, w: WindowSpec) -> DataFrame:
        # One layer of columns per dependency on another window: each layer is one pass over the sorted block.
        first = {"Log_Return": R.log_return("close", w), "_tr": R.true_range(w)}
        second = {
            TARGET: F.lead("Log_Return", 1).over(w),
            **R.lags("Log_Return", LAGS, w),
            "_sma20": R.sma("close", 20, w),
            "_sma50": R.sma("close", 50, w),
            "_std20": R.rolling_std("close", 20, w),
            "Rolling_Std_14": R.rolling_std("Log_Return", 14, w),
            "Volume_Shock": ratio("volume", R.sma("volume", 10, w)),
            "Volume_ROC_5": R.pct_change("volume", 5, w),
            "ATR_14": R.sma("_tr", 14, w),
        }
        if obv:
            second["OBV_ROC_5"] = R.pct_change("OBV", 5, w)
        third = {
            "Distancia_SMA_20": ratio("close", "_sma20") - 1,
            "Distancia_SMA_50": ratio("close", "_sma50") - 1,
            "Bollinger_Width": ratio(4 * F.col("_std20"), "_sma20"),
            "ATR_Pct": ratio("ATR_14", "close"),
            **calendar_features("date"),
            **oscillator_columns(state, rsi_flat),
        }
        return df.withColumns(first).withColumns(second).withColumns(third)

    if bounded:
        out = build(with_state_bounded(joined, state), Window.partitionBy("symbol").orderBy("date"))
    else:
        out = windowed(with_state(joined, state), build, before=before, after=1, size=max(size, before))
    return out.select("symbol", "date", *wanted, TARGET)


def features(
    bars: DataFrame,
    macro_returns: DataFrame | None = None,
    sentiment: DataFrame | None = None,
    training: bool = True,
    groups: Sequence[str] = FULL,
    size: int = BLOCK_ROWS,
    bounded: bool = False,
) -> DataFrame:
    """Feature table; training mode drops rows without a target, inference mode keeps the latest row.

    ``bounded`` says that a symbol has few rows, such as a tail.
    """
    raw = raw_features(bars, macro_returns, sentiment, groups, size=size, bounded=bounded)
    return keep_complete(raw, columns_of(groups), TARGET, training, bounded=bounded)


def eda_features(bars: DataFrame) -> DataFrame:
    """Technical features only; an undefined RSI stays NULL and every incomplete row is dropped."""
    return raw_features(bars, groups=EDA, rsi_flat=None).na.drop()


def training_set(bars: DataFrame, macro_long: DataFrame, sentiment: DataFrame | None = None) -> DataFrame:
    """Training features with the macro series cut to the range of the bars (plus the padding).

    The range is a pair of scalar subqueries, not fetched to the driver.
    """
    inside = macro_range(macro_long, bars.agg(F.min("date")).scalar(), bars.agg(F.max("date")).scalar())
    return features(bars, macro_returns(inside), sentiment, training=True)
