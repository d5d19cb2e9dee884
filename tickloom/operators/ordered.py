"""Running totals in value order, exact and without sorting a whole group in one task.

Distribution tests and exact quantiles need the values of a group in order.  A group may
hold a third of all rows, so its distinct values are cut at approximate quantiles into
parts of similar size; each part is sorted by its own task and shifted by the totals
of the parts before it.  The cut points only balance the work, they never change the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalar import ratio
from tickloom.operators.series import attach
from tickloom.session import ensure_checkpoint_dir, written

ROWS_PER_PART = 2_000_000
MIN_PARTS = 4


def _cuts_below(cuts: Column, value: Column, parts: int) -> Column:
    """How many of the sorted cuts, fewer than ``parts``, are smaller than the value: a binary search, log2(parts) steps."""
    span = F.struct(F.lit(0).alias("low"), F.size(cuts).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        below = F.struct((middle + 1).alias("low"), s["high"].alias("high"))
        above = F.struct(s["low"].alias("low"), middle.alias("high"))
        return F.when(s["low"] >= s["high"], s).when(F.get(cuts, middle) < value, below).otherwise(above)

    return F.aggregate(F.sequence(F.lit(1), F.lit(parts.bit_length())), span, halve, lambda s: s["low"])


def cumulative(
    df: DataFrame, keys: Sequence[str], value: str, measures: Mapping[str, Column], parts: int | None = None
) -> DataFrame:
    """One row per distinct value of each group, with each measure's sum (``m``), the sum up to and including the
    value (``m_upto``) and over the group (``m_total``), and the next larger value (``next_value``).
    """
    # The input is read once: everything below works on the table of distinct values.
    distinct = written(df.groupBy(*keys, value).agg(*[F.sum(m).alias(n) for n, m in measures.items()]), "values")

    # The cuts are approximate and could come out differently when a lost task runs again, and
    # rows and part totals must agree on them: the tiny table is fixed by a reliable checkpoint.
    ensure_checkpoint_dir(df.sparkSession)
    if parts is None:  # the row count comes from the footers of the table just written
        parts = max(MIN_PARTS, -(-distinct.count() // ROWS_PER_PART))
    parts = max(2, parts)
    probabilities = [i / parts for i in range(1, parts)]
    cuts = distinct.groupBy(*keys).agg(F.percentile_approx(value, probabilities, 10 * parts).alias("_cuts")).checkpoint()
    part = _cuts_below(F.col("_cuts"), F.col(value), parts)
    placed = attach(distinct, cuts, keys, value).withColumn("_part", part).drop("_cuts").repartition(*keys, "_part")

    inside = Window.partitionBy(*keys, "_part").orderBy(value)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns(
        {**{f"_{m}": F.sum(m).over(upto) for m in measures}, "_next": F.lead(value, 1).over(inside)}
    )

    across = Window.partitionBy(*keys).orderBy("_part")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys)
    offsets = (
        placed.groupBy(*keys, "_part")
        .agg(F.min(value).alias("_first"), *[F.sum(m).alias(f"_sum_{m}") for m in measures])
        .select(
            *keys,
            "_part",
            F.lead("_first", 1).over(across).alias("_next_first"),
            *[F.coalesce(F.sum(f"_sum_{m}").over(earlier), F.lit(0)).alias(f"_before_{m}") for m in measures],
            *[F.sum(f"_sum_{m}").over(group).alias(f"{m}_total") for m in measures],
        )
    )
    return local.join(offsets, [*keys, "_part"]).select(
        *keys,
        value,
        *measures,
        *[(F.col(f"_before_{m}") + F.col(f"_{m}")).alias(f"{m}_upto") for m in measures],
        *[f"{m}_total" for m in measures],
        F.coalesce("_next", "_next_first").alias("next_value"),
    )


def quantile_of(c: DataFrame, keys: Sequence[str], value: str, measure: str, probabilities: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group from a ``cumulative`` table, one column each."""
    upto, total = F.col(f"{measure}_upto"), F.col(f"{measure}_total")
    start = upto - F.col(measure)
    picks = []
    for name, p in probabilities.items():
        position = (total - 1) * F.lit(p)
        for side, index in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            picks.append(F.max(F.when((start <= index) & (index < upto), F.col(value))).alias(f"_{side}_{name}"))
    found = c.groupBy(*keys).agg(F.max(f"{measure}_total").alias("_n"), *picks)

    def blend(name: str, p: float) -> Column:
        position = (F.col("_n") - 1) * F.lit(p)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (lo + (hi - lo) * (position - F.floor(position))).alias(name)

    return found.select(*keys, *[blend(n, p) for n, p in probabilities.items()])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float], parts: int | None = None) -> DataFrame:
    """Exact interpolated quantiles per group."""
    known = df.filter(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    c = cumulative(known, keys, value, {"_rows": F.lit(1)}, parts)
    return quantile_of(c, keys, value, "_rows", probabilities)


def share_upto(measure: str) -> Column:
    """Empirical distribution function of a measure."""
    return ratio(f"{measure}_upto", f"{measure}_total")
