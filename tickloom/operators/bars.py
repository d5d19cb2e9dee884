"""Bars: ticks to bars, incremental loading behind a pointer, calendar fill, macro returns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalar import log_ratio
from tickloom.operators.series import attach, windowed
from tickloom.schemas import MACRO_SERIES, OHLCV

LOOKBACK_DAYS = 200
MACRO_PAD_DAYS = 5
FULL_NEWS_DAYS = 360


def bars_from_ticks(
    ticks: DataFrame,
    ts: str = "date",
    price: str = "price",
    tie: str | None = None,
    quantity: str = "quantity",
    every: Column | None = None,
    out: str = "date",
) -> DataFrame:
    """One bar per symbol and period.  All aggregates combine before the shuffle, so a hot symbol-day stays small."""
    order = F.struct(ts, tie) if tie and tie != ts else F.col(ts)
    if tie and every is None:
        order = F.col(tie)
    period = F.col(ts) if every is None else every
    return ticks.groupBy("symbol", period.alias(out)).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(quantity).cast("bigint").alias("volume"),
    )


def project(bars: DataFrame, full: bool = False) -> DataFrame:
    return bars if full else bars.select("symbol", "date", *OHLCV)


def next_start(pointer: DataFrame, as_of: dt.date) -> DataFrame:
    """First date to load per symbol: the day after the pointer, or the pointer itself once it has reached ``as_of``."""
    last = F.col("last_date")
    return pointer.withColumn("start_date", F.when(last >= F.lit(as_of), last).otherwise(F.date_add(last, 1)))


def bars_since(bars: DataFrame, pointer: DataFrame, as_of: dt.date) -> DataFrame:
    """New bars per symbol; a symbol without a pointer is loaded in full."""
    starts = next_start(pointer, as_of).select("symbol", "start_date")
    return (
        attach(bars, starts, how="left")
        .filter(F.col("start_date").isNull() | (F.col("date") >= F.col("start_date")))
        .drop("start_date")
    )


def update_pointer(pointer: DataFrame, batch: DataFrame) -> DataFrame:
    """Pointer after a batch: its latest date per symbol; a symbol without new rows keeps its pointer."""
    fresh = batch.groupBy("symbol").agg(F.max("date").alias("_new"))
    return pointer.join(fresh, "symbol", "full").select("symbol", F.coalesce("_new", "last_date").alias("last_date"))


def macro_range(macro: DataFrame, min_date: Column | dt.date, max_date: Column | dt.date, pad_days: int = MACRO_PAD_DAYS):
    """Macro rows from ``min_date`` to before ``max_date`` plus the padding."""
    low = min_date if isinstance(min_date, Column) else F.lit(min_date)
    high = max_date if isinstance(max_date, Column) else F.lit(max_date)
    return macro.filter((F.col("date") >= low) & (F.col("date") < F.date_add(high, pad_days)))


def macro_lookback(macro: DataFrame, as_of: dt.date, days: int = LOOKBACK_DAYS) -> DataFrame:
    return macro_range(macro, as_of - dt.timedelta(days=days), as_of)


def macro_wide(macro: DataFrame) -> DataFrame:
    """One row per date and one close column per series (fixed set, so no extra pass to find the series)."""
    names = list(MACRO_SERIES)
    wide = macro.groupBy("date").pivot("series", names).agg(F.first("close"))
    return wide.select("date", *[F.col(n).alias(f"{n}_Close") for n in names])


def macro_returns(macro: DataFrame) -> DataFrame:
    """Log returns per series over the joint calendar; a gap gives 0 on its day and on the next one."""
    wide = macro_wide(macro)  # one series, so the key is empty

    def build(df, w):
        return df.withColumns(
            {
                out: F.coalesce(log_ratio(f"{n}_Close", F.lag(f"{n}_Close", 1).over(w)), F.lit(0.0))
                for n, out in MACRO_SERIES.items()
            }
        )

    return windowed(wide, build, before=1, key=()).select("date", *MACRO_SERIES.values())


def join_macro(bars: DataFrame, returns: DataFrame) -> DataFrame:
    """Left join on the date, no match gives 0.

    ``returns`` has one row per calendar date (``macro_wide`` groups by it), so its size is bounded by the
    calendar whatever the data: a century is about a megabyte.  That is why it may be broadcast; any other type of ``date`` is an error.
    """
    if not isinstance(returns.schema["date"].dataType, T.DateType):
        raise TypeError("macro returns need a column date of type DATE")
    names = list(MACRO_SERIES.values())
    return bars.join(F.broadcast(returns), "date", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in names})


def join_sentiment(bars: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Left join on symbol and date, no match gives 0."""
    right = sentiment.select("symbol", "date", F.col("sentiment_score").alias("Sentiment_Score"))
    return bars.join(right, ["symbol", "date"], "left").withColumn(
        "Sentiment_Score", F.coalesce("Sentiment_Score", F.lit(0.0))
    )


def fill_calendar(bars: DataFrame, columns: list[str]) -> DataFrame:
    """Every calendar day from a symbol's first bar to its last, with the latest earlier values.

    Each bar fans out to the days before the next bar, so no calendar join is needed.
    """

    def build(df, w):
        return df.withColumn("_next", F.lead("date", 1).over(w))

    days = F.sequence(F.col("date"), F.coalesce(F.date_sub("_next", 1), F.col("date")))
    return windowed(bars.select("symbol", "date", *columns), build, after=1).select(
        "symbol", F.explode(days).alias("date"), *columns
    )
