"""Window expressions for time series.  ``w`` is a window ordered by time (see ``operators.series.windowed``)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.scalar import col, log_ratio, ratio


def rolling(agg: Callable[[Column], Column], c: Column | str, n: int, w: WindowSpec) -> Column:
    """``agg`` over the last ``n`` rows, NULL until all ``n`` are present and not NULL."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(c)).over(frame) == n, agg(col(c)).over(frame))


def sma(c: Column | str, n: int, w: WindowSpec) -> Column:
    return rolling(F.avg, c, n, w)


def rolling_std(c: Column | str, n: int, w: WindowSpec) -> Column:
    return rolling(F.stddev_samp, c, n, w)


def log_return(c: Column | str, w: WindowSpec, k: int = 1) -> Column:
    return log_ratio(col(c), F.lag(col(c), k).over(w))


def pct_change(c: Column | str, k: int, w: WindowSpec) -> Column:
    """Relative change over ``k`` rows; NULL where the earlier value is 0."""
    return ratio(c, F.lag(col(c), k).over(w)) - 1


def lags(c: str, ks: Sequence[int], w: WindowSpec, prefix: str = "Lag_") -> dict[str, Column]:
    return {f"{prefix}{k}": F.lag(c, k).over(w) for k in ks}


def signed_volume(w: WindowSpec) -> Column:
    """Volume of an up day, minus volume of a down day, else 0."""
    previous = F.lag("close", 1).over(w)
    return F.when(F.col("close") > previous, F.col("volume")).when(F.col("close") < previous, -F.col("volume")).otherwise(0)


def true_range(w: WindowSpec) -> Column:
    previous = F.lag("close", 1).over(w)
    high, low = F.col("high"), F.col("low")
    return F.greatest(high - low, F.abs(high - previous), F.abs(low - previous))
