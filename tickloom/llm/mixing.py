"""Mixing sources to target weights, by entropy balancing.

Every source gets a target number of words: all words are shared by the sources' weights, but a source gives at most ``MOST`` times
its own words, and what is above is shared again by weight. Then each document gets a rate, how often the mix should take it.
Of all rates between 0 and ``MOST`` that meet the targets these are the ones closest to one, by relative entropy. The convex
dual has one multiplier a source, and the rates are exponentially tilted by size: ``min(MOST, exp(multiplier * size / largest))``.

Newton's method finds the multipliers. All documents of one source and size have the same rate, so the steps run on counts by
source and size; each step is one Spark aggregate, which gives the words at the current multipliers and their slope, and
a table of multipliers in the shared folder. Steps are taken on the logarithm and kept inside a bracket that
shrinks with each, so they always converge. Sums are of integers (rates in units of ``1 / ONE``), hence the same in any order.

Rates become whole copies by size, largest first: each size's copies make up for what the larger ones were rounded by, within
its rate rounded down and up; a second pass and swaps of one copy of a size for one of another spend what is left over. Within a size the documents that get one copy
more are the first by a hash of all their columns. A source's words differ from its target only as far as whole documents of
at most ``MOST`` copies allow.

Bounds: a source of w words has at most sqrt(2 w) sizes, which is what one task sees when copies are dealt. Ranks come from a range
shuffle, so the rows of one size, and identical rows too, are spread over all tasks. Sources are one row each, never on the driver.

Edge cases: sources are ordered by code point, null is a source and comes last. A null text has no words; documents without words get one copy,
a source without words has the target 0. Repeated rows and null ids are documents of their own. Reruns agree; which of several
identical rows gets one more copy does not. Other columns are kept whatever their names. An empty table gives an empty mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import documents, text_of
from tickloom.session import written

WEIGHTS = (1, 2, 3)
MOST = 3
ONE = 1 << 20
TOLERANCE = 1e-6
STEPS = 200


def words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_key(source: Column) -> Column:
    """Strings in the order of the sources, null last."""
    return F.coalesce(F.concat(F.lit("a"), source.cast("string")), F.lit("b"))


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with a gapless ``rank`` from 0 within ``by`` (not null), and ``part``. ``order`` is unique within ``by``.

    The rows are dealt by ranges of ``by`` and ``order``, so no task holds more than its share of a group; a rank is the place
    in the part and the group's rows in the parts before.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(rows.repartitionByRange(parts, *by, *order).withColumn("part", F.spark_partition_id()), name)
    local = F.row_number().over(Window.partitionBy(*by, "part").orderBy(*order)) - 1
    upto = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*by, "part").count()  # as many rows of a group as there are parts
    before = sizes.select(*by, "part", F.coalesce(F.sum("count").over(upto), F.lit(0)).alias("before"))
    return placed.withColumn("local", local).join(before, [*by, "part"]).withColumn("rank", F.col("before") + F.col("local")).drop("before", "local")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (``s, source_size``) with ``target``."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    weighted = written(ranked(sources, [], ["s"], "mix-ranks").withColumn("weight", weight).drop("rank", "part"), "mix-sources")
    level, full = 0.0, -1
    while True:  # each round shares what the full sources leave; their number only grows
        above = F.lit(most) * F.col("source_size") < F.lit(level) * F.col("weight")
        row = weighted.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(above, most * F.col("source_size")).otherwise(0)).alias("held"),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("open"), F.sum(above.cast("int")).alias("full"),
        ).first()
        if not row["open"] or row["full"] == full:
            break
        level, full = (row["all"] - row["held"]) / row["open"], row["full"]
    share = F.least(F.lit(most) * F.col("source_size").cast("double"), F.lit(level) * F.col("weight"))
    return weighted.withColumn("target", share).drop("weight")


def rate(most: int) -> Column:
    """Copies of a document, in units of ``1 / ONE``, by its size and its source's multiplier."""
    tilted = F.least(F.lit(float(most)), F.exp(F.col("multiplier") * F.col("size") / F.col("largest")))
    return F.when(F.col("full"), F.lit(most * ONE)).otherwise(F.round(tilted * ONE).cast("long"))


def multipliers(sizes: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """``sources`` with ``multiplier``, by Newton steps over ``sizes`` (``s, size, n``)."""
    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    x = F.col("size") / F.col("largest")
    weighted = exact(F.col("n") * F.col("size") * F.round(x * ONE).cast("long"))
    facts = sizes.where("size > 0").join(sources, "s").withColumn("largest", F.col("largest"))
    facts = facts.groupBy("s").agg(weighted.alias("moment"), F.min("size").alias("least"))
    ratio = F.col("target") / F.col("source_size")
    # the bracket: at its ends the smallest document alone has the mean rate
    far = F.log(ratio) * F.col("largest") / F.col("least")
    guess = F.log(ratio) * F.col("source_size") * ONE / F.col("moment").cast("double")
    state = sources.join(facts, "s").withColumns(
        {
            "full": F.col("target") >= F.lit(most) * F.col("source_size") * (1 - 1e-12),
            "low": F.least(far, F.lit(0.0)),
            "high": F.greatest(far, F.lit(0.0)),
            "multiplier": guess,
            "done": F.lit(False),
        }
    )
    state = written(state.withColumn("done", F.col("full")).drop("moment", "least"), "mix-state")
    for _ in range(STEPS):
        if state.where(~F.col("done")).isEmpty():
            return state
        now = sizes.where("size > 0").join(state.where(~F.col("done")).select("s", "largest", "full", "multiplier"), "s").withColumn("rate", rate(most))
        free = F.when(F.col("rate") < most * ONE, F.col("rate")).otherwise(0)
        sums = now.groupBy("s").agg(
            exact(F.col("n") * F.col("size") * F.col("rate")).alias("words"), exact(F.col("n") * F.col("size") * F.round(x * free).cast("long")).alias("slope")
        )
        words, slope = F.col("words").cast("double") / ONE, F.col("slope").cast("double") / ONE
        low = F.when(words < F.col("target"), F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(words > F.col("target"), F.col("multiplier")).otherwise(F.col("high"))
        newton = F.when((slope > 0) & (words > 0), F.col("multiplier") + F.log(F.col("target") / words) * words / slope)
        near = F.abs(words - F.col("target")) <= TOLERANCE * F.col("target")
        step = state.join(sums, "s", "left").withColumns({"l": low, "h": high, "next": newton, "near": F.col("done") | F.coalesce(near, F.lit(False))})
        step = step.withColumn("done", F.col("near") | ((F.col("h") - F.col("l")) <= 1e-13 * (F.abs(F.col("l")) + F.abs(F.col("h")))))
        inside = F.when((F.col("next") > F.col("l")) & (F.col("next") < F.col("h")), F.col("next")).otherwise((F.col("l") + F.col("h")) / 2)
        state = written(
            step.select(
                "s", "source_size", "target", "largest", "full", F.col("l").alias("low"), F.col("h").alias("high"),
                F.when(F.col("done"), F.col("multiplier")).otherwise(inside).alias("multiplier"), "done",
            ),
            "mix-state",
        )
    raise RuntimeError(f"multipliers did not converge in {STEPS} steps")


def dealt(sizes: pd.DataFrame, most: int = MOST) -> pd.DataFrame:
    """One source's ``size, n, rate, target`` with whole ``copies`` of each size."""
    sizes = sizes.sort_values("size", ascending=False, kind="stable")
    rows = list(zip(sizes["size"].tolist(), sizes["n"].tolist(), sizes["rate"].tolist()))
    copies, carry = [], 0
    for size, n, units in rows:
        if not size:
            copies.append(n)
            continue
        carry += n * size * units
        whole = (2 * carry + size * ONE) // (2 * size * ONE)
        whole = min(max(whole, n * (units // ONE)), n * -(-units // ONE))
        copies.append(whole)
        carry -= whole * size * ONE
    left = round(float(sizes["target"].iloc[0])) - sum(size * c for (size, _, _), c in zip(rows, copies))
    for k, (size, n, _) in enumerate(rows):
        if size and 2 * abs(left) >= size:
            whole = min(max(copies[k] + (2 * left + size) // (2 * size), 0), most * n)
            left -= (whole - copies[k]) * size
            copies[k] = whole
    return sizes.assign(copies=swapped(rows, copies, left, most))


def swapped(rows: list[tuple[int, int, int]], copies: list[int], left: int, most: int, rounds: int = 8) -> list[int]:
    """``copies`` with one more of one size and one less of another, as long as that brings the words closer to the target."""
    for _ in range(rounds):
        sign = 1 if left > 0 else -1
        more = [k for k, (size, n, _) in enumerate(rows) if size and (copies[k] < most * n if sign > 0 else copies[k] > 0)]
        less = [k for k, (size, n, _) in enumerate(rows) if size and (copies[k] > 0 if sign > 0 else copies[k] < most * n)]
        found = np.asarray([rows[k][0] for k in less][::-1])  # ascending
        wanted = np.asarray([rows[k][0] for k in more]) - abs(left)
        if not left or not len(found) or not len(wanted):
            break
        at = np.searchsorted(found, wanted)
        pairs = [(abs(int(w) - int(found[j])), k, less[len(less) - 1 - j]) for w, a, k in zip(wanted, at, more) for j in (a - 1, a) if 0 <= j < len(found)]
        off, one, other = min(pairs)
        if off >= abs(left):
            break
        copies[one] += sign
        copies[other] -= sign
        left -= sign * (rows[one][0] - rows[other][0])
    return copies


def mixed(docs: DataFrame, source: Column, size: Column, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``row`` (all columns of ``docs``), ``size``, ``source_size``, ``target``, ``rate`` and ``copies`` of each document.

    The rows are written once and shuffled once; leave out texts that are joined again later.
    """
    told = [F.col(f"`{c}`") for c, kind in docs.dtypes if not kind.startswith("map") and "map<" not in kind]
    rows = docs.select(
        F.struct("*").alias("row"), source_key(source).alias("s"), F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        F.xxhash64(*told).alias("hash"), F.monotonically_increasing_id().alias("number"),
    )
    rows = written(rows, "mix-rows")
    sizes = written(rows.groupBy("s", "size").agg(F.count("*").alias("n")), "mix-sizes")
    sources = sizes.groupBy("s").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.max("size").alias("largest"))
    sources = written(targets(sources, weights, most), "mix-targets")
    state = multipliers(sizes, sources.where("source_size > 0"), most).select("s", "largest", "full", "multiplier")
    rated = sizes.join(sources.drop("largest"), "s").join(state, "s", "left").withColumn("rate", F.coalesce(F.when(F.col("size") > 0, rate(most)), F.lit(ONE)))
    kind = "s string, size long, n long, source_size long, target double, rate long, copies long"
    plan = rated.select("s", "size", "n", "source_size", "target", "rate").groupBy("s").applyInPandas(lambda group: dealt(group, most), kind)
    plan = written(plan, "mix-plan")
    numbered = ranked(rows, ["s", "size"], ["hash", "number"], "mix-order")
    # joined by part as well: a size that a third of all rows have is spread over its parts
    parts = numbered.select("s", "size", "part").distinct().join(plan, ["s", "size"])
    copies = F.floor(F.col("copies") / F.col("n")) + (F.col("rank") < F.col("copies") % F.col("n")).cast("long")
    joined = numbered.join(parts, ["s", "size", "part"])
    return joined.select("row", "size", "source_size", "target", (F.col("rate") / ONE).alias("rate"), copies.cast("long").alias("copies"))


def op11_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", words_of(text_of()).alias("size"))
    mix = mixed(docs, F.col("source"), F.col("size"))
    return mix.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")
