"""Column expressions: null rules, calendar, text, news polarity, price reconstruction."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0 (ANSI division would fail the query)."""
    return F.try_divide(col(a), col(b))


def null_if_nan(c: Column | str) -> Column:
    """NaN becomes NULL, so that aggregates skip it."""
    return F.when(~F.isnan(col(c)), col(c))


def finite(c: Column | str) -> Column:
    """NULL unless the value is a finite number."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(math.inf)), x)


def log_ratio(now: Column | str, then: Column | str) -> Column:
    return F.ln(ratio(now, then))


def rounded(c: Column | str, digits: int) -> Column:
    """Rounded value without negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def month_of(d: Column | str) -> Column:
    return F.month(col(d))


def weekday_of(d: Column | str) -> Column:
    """Monday is 0."""
    return F.weekday(col(d))


def cyclic(part: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a calendar part on a circle of ``period`` steps."""
    angle = F.lit(2 * math.pi) * part / F.lit(period)
    return F.sin(angle), F.cos(angle)


def calendar_features(d: Column | str) -> dict[str, Column]:
    """Cyclic month (of 12) and weekday (of 5, so weekend days wrap)."""
    month_sin, month_cos = cyclic(month_of(d), 12)
    day_sin, day_cos = cyclic(weekday_of(d), 5)
    return {"Month_Sin": month_sin, "Month_Cos": month_cos, "Day_Sin": day_sin, "Day_Cos": day_cos}


def ticker(c: Column | str) -> Column:
    """Normalised ticker text."""
    return F.upper(F.trim(col(c)))


def drop_zone(ts: Column | str) -> Column:
    """Wall-clock date of a timestamp, its zone dropped and not converted."""
    return F.to_date(col(ts).cast(T.TimestampNTZType()))


def epoch_local_date(seconds: Column | str, zone: str = "America/Sao_Paulo") -> Column:
    """Local calendar date of an epoch second, whatever the session time zone is."""
    utc = F.lit("1970-01-01 00:00:00").cast(T.TimestampNTZType()) + F.make_dt_interval(secs=col(seconds))
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc))


def utc_instant(wall_clock: Column | str) -> Column:
    """The instant whose UTC wall clock this is (a plain cast would read it in the session time zone)."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), col(wall_clock)).cast("timestamp")


def utc_date(instant: Column | str) -> Column:
    local = col(instant).cast(T.TimestampNTZType())
    return F.to_date(F.convert_timezone(F.current_timezone(), F.lit("UTC"), local))


def polarity(scores: Column | str) -> Column:
    """Sum of positive scores minus sum of negative ones; other labels count 0, so does an absent list."""

    def add(acc: Column, item: Column) -> Column:
        label = F.lower(item["label"])
        return acc + F.when(label == "positive", item["score"]).when(label == "negative", -item["score"]).otherwise(0.0)

    return F.coalesce(F.aggregate(col(scores), F.lit(0.0), add), F.lit(0.0))


def price_after(price: Column | str, log_return: Column | str) -> Column:
    return col(price) * F.exp(col(log_return))


def variation_pct(log_return: Column | str) -> Column:
    return (F.exp(col(log_return)) - 1) * 100


def candle_color() -> Column:
    return F.when(F.col("close") < F.col("open"), "red").otherwise("green")
