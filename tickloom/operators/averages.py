"""Exponential averages over series of any length, exact over the whole history."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.series import BLOCK_ROWS, PREFIX_FAN, Keys, _keys, number_rows

MAX_LOG = 600.0  # exp of this is still a finite double, with room for the values themselves


def block_rows(spans: list[int], wanted: int = BLOCK_ROWS) -> int:
    """Largest block up to ``wanted`` rows in which the weights of these spans, all above 1, stay inside the range of a double."""
    decay = max(-math.log(1 - 2 / (s + 1)) for s in spans)
    return max(1, min(wanted, int(MAX_LOG / decay)))


def with_averages(
    df: DataFrame, averages: dict[str, tuple[str, int]], key: Keys = "symbol", order: str = "date", size: int = BLOCK_ROWS, fan: int = PREFIX_FAN
) -> DataFrame:
    """Add columns ``out: (column, span)`` with y = (1-a)y + ax, a = 2/(span+1), started at the first value of the series.

    A row's average is that of its block from a zero start, plus the average before the block times a power: a running sum
    costs one addition per row. Averages before blocks come from the blocks' own sums, folded in order within groups of
    ``fan`` blocks and then over the groups, so no history is left out. A NULL value is an error: fill it first.
    ``_rn`` is taken as the position in the series if it is there, and kept.
    """
    same = {out: F.col(c).cast("double") for out, (c, span) in averages.items() if span == 1}  # the value itself
    averages = {out: a for out, a in averages.items() if out not in same}
    df = df.withColumns(same)
    if not averages:
        return df
    keys = _keys(key)
    size = block_rows([span for _, span in averages.values()], size)
    numbered = "_rn" in df.columns
    rows = df if numbered else number_rows(df, keys, order)
    rows = rows.withColumn("_eb", F.floor(F.col("_rn") / size)).withColumn("_ep", F.col("_rn") % size).repartition(*keys, "_eb")
    upto = Window.partitionBy(*keys, "_eb").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)

    def kept(span: int) -> Column:
        return F.lit(1 - 2 / (span + 1))

    def weighted(column: str, span: int) -> Column:
        value = F.coalesce(F.col(column).cast("double"), F.raise_error(F.lit(f"{column} is NULL: fill it before averaging")).cast("double"))
        return value * F.when(F.col("_rn") == 0, 1.0).otherwise(2 / (span + 1)) * F.pow(kept(span), -F.col("_ep").cast("double"))

    sums = [(F.sum(weighted(c, s)) * F.pow(kept(s), F.max("_ep").cast("double"))).alias(out) for out, (c, s) in averages.items()]
    blocks = rows.groupBy(*keys, "_eb").agg((F.max("_ep") + 1).alias("_n"), *sums).withColumn("_eg", F.floor(F.col("_eb") / fan))
    spans = {out: span for out, (_, span) in averages.items()}
    inner = _before(blocks, [*keys, "_eg"], "_eb", spans)
    groups = blocks.groupBy(*keys, "_eg").agg(F.sum("_n").alias("_n")).join(inner.where("_last").select(*keys, "_eg", *[F.col(f"_end_{o}").alias(o) for o in spans]), [*keys, "_eg"])
    outer = _before(groups, keys, "_eg", spans).select(*keys, "_eg", *[F.col(f"_in_{o}").alias(f"_up_{o}") for o in spans])
    since = ((F.col("_eb") - F.col("_eg") * fan) * size).cast("double")
    carry = inner.join(outer, [*keys, "_eg"]).select(
        *keys, "_eb", *[(F.col(f"_in_{o}") + F.pow(kept(s), since) * F.col(f"_up_{o}")).alias(f"_c_{o}") for o, s in spans.items()]
    )
    place = F.col("_ep").cast("double")
    local = rows.withColumns({f"_l_{o}": F.sum(weighted(c, s)).over(upto) * F.pow(kept(s), place) for o, (c, s) in averages.items()})
    out = local.join(carry, [*keys, "_eb"]).withColumns({o: F.col(f"_l_{o}") + F.pow(kept(s), place + 1) * F.col(f"_c_{o}") for o, s in spans.items()})
    return out.select(*[c for c in df.columns if c not in averages], *averages)


def _before(parts: DataFrame, keys: list[str], part: str, spans: dict[str, int]) -> DataFrame:
    """For each part of a key, in order: the average before it (``_in_``) and after it (``_end_``) from a zero start.

    A part has ``_n`` rows and, in the column of each average, what it ends with from a zero start. ``_last`` marks a key's last part.
    """
    held = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(part, "_n", *spans))).alias("_p"))

    def scan(out: str, span: int) -> Column:
        empty = F.struct(F.lit(0.0).alias("y"), F.array().cast("array<double>").alias("seen"))

        def add(state: Column, x: Column) -> Column:
            after = state["y"] * F.pow(F.lit(1 - 2 / (span + 1)), x["_n"].cast("double")) + x[out]
            return F.struct(after.alias("y"), F.concat(state["seen"], F.array(after)).alias("seen"))

        return F.aggregate("_p", empty, add, lambda state: state["seen"])

    scanned = held.withColumns({f"_s_{o}": scan(o, s) for o, s in spans.items()})
    each = scanned.select(*keys, F.size("_p").alias("_parts"), *[f"_s_{o}" for o in spans], F.posexplode("_p").alias("_k", "_x"))
    return each.select(
        *keys, F.col(f"_x.{part}").alias(part), (F.col("_k") == F.col("_parts") - 1).alias("_last"),
        *[F.coalesce(F.get(f"_s_{o}", F.col("_k") - 1), F.lit(0.0)).alias(f"_in_{o}") for o in spans],
        *[F.get(f"_s_{o}", F.col("_k")).alias(f"_end_{o}") for o in spans],
    )
