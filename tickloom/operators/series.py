"""Windows over long series without putting a whole series into one task.

``Window.partitionBy("symbol")`` sends every row of a symbol to one task, so one
symbol with a third of all rows stalls the job.  Here a series is first numbered
(row counts per calendar chunk, then a running total over the few chunks) and then
cut into blocks of equal row count.  Each block also gets copies of the rows just
before and after it, enough for the widest frame in use, so ordinary window
functions over ``(symbol, block)`` give the same values as over the whole series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import written

BLOCK_ROWS = 2048
CHUNK_DAYS = 2048  # days per numbering chunk of a daily series
PREFIX_FAN = 1024

Keys = str | Sequence[str]


def _keys(key: Keys) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def number_rows(
    df: DataFrame,
    key: Keys = "symbol",
    order: str = "date",
    out: str = "_rn",
    chunk_days: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add the 0-based position of each row in its series, ordered by a date or timestamp unique per key.

    A daily series is sorted per (key, calendar chunk); the running total runs over one row per
    chunk, whose number is bounded by the calendar and not by the row count.  ``counted`` may name a
    cheaper table with the same keys and order values to count, such as the input of a join that keeps its rows.
    Timestamps are cut by ``number_by_range``, as a single day may hold any number of them.
    """
    keys = _keys(key)
    if chunk_days is None and not isinstance(df.schema[order].dataType, T.DateType):
        return number_by_range(df, keys, order, out)
    days = chunk_days or CHUNK_DAYS

    def with_chunk(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_chunk", F.floor(F.unix_date(F.to_date(order)) / days))

    chunked = with_chunk(df)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        (chunked if counted is None else with_chunk(counted))
        .groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, "_chunk", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order)
    # The explicit repartition matters: input that is already partitioned by the key alone would
    # satisfy the window as it is and leave a hot key in one task.
    return (
        chunked.repartition(*keys, "_chunk")
        .withColumn("_local", F.row_number().over(inside))
        .join(starts, [*keys, "_chunk"])
        .withColumn(out, F.col("_start") + F.col("_local") - 1)
        .drop("_chunk", "_local", "_start")
    )


def number_by_range(df: DataFrame, key: Keys, order: str, out: str = "_rn") -> DataFrame:
    """``number_rows`` for any order: rows are cut at sampled quantiles of (key, order) into as many parts as a shuffle has.

    No task holds more than its share of a key, however close together its rows are. The parts are fixed by a written table, so that
    a lost executor cannot cut them anew; a position is that in the part and the key's rows in the parts before.
    """
    keys = _keys(key)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(parts, *keys, order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    starts = starts.select(*keys, "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order))
    numbered = placed.withColumn("_local", local).join(starts, [*keys, "_part"])
    return numbered.withColumn(out, F.col("_start") + F.col("_local") - 1).drop("_part", "_local", "_start")


def attach(
    df: DataFrame, stats: DataFrame, key: Keys = "symbol", spread: Keys = "date", how: str = "inner", salts: int | None = None
) -> DataFrame:
    """Join a table with one row per key to the rows of a series.

    A plain join on the key alone would bring all rows of a hot key to one task.  Here the rows of a key
    are spread over ``salts`` tasks, by default as many as a shuffle has, by a hash of ``spread`` or of all columns, and the
    small side is repeated for each; if it
    proves small enough at run time, Spark broadcasts it and shuffles nothing.
    """
    keys = _keys(key)
    spreading = _keys(spread) or df.columns
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*spreading), F.lit(salts))
    salted = df.withColumn("_salt", salt)
    repeated = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def first_rows(df: DataFrame, key: Keys, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each key.

    Rows are ranked within a key's salts first, as many as a shuffle has tasks, and what is left of these within the key, so
    that no task sees more of a hot key than ``n`` rows for each salt. Spark cuts to ``n`` before either shuffle as well.
    """
    keys = _keys(key)
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = [c for c, kind in df.dtypes if not kind.startswith("map") and "map<" not in kind]
    out = df.withColumn("_salt", F.pmod(F.xxhash64(*values), F.lit(salts)))
    for level in ([*keys, "_salt"], keys):
        w = Window.partitionBy(*level).orderBy(*order)
        out = out.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")
    return out.drop("_salt")


def windowed(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    before: int = 0,
    after: int = 0,
    key: Keys = "symbol",
    order: str = "date",
    size: int = BLOCK_ROWS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Run ``build(df, w)`` on blocks; its frames may reach ``before`` rows back and ``after`` rows ahead.

    Inside ``build`` the frame has ``_rn`` (position in the series), ``_pos`` (position in
    the block), ``_block`` and ``_own`` (false for copied rows).  Names in ``keep``
    survive; the copies and the other helper columns do not.
    """
    size = max(size, before, after)
    keys = _keys(key)
    rows = df if "_rn" in df.columns else number_rows(df, keys, order)
    home = F.floor(F.col("_rn") / size)
    offset = F.col("_rn") % size
    targets = [home]
    if before:
        targets.append(F.when(offset >= size - before, home + 1))
    if after:
        targets.append(F.when((offset < after) & (home > 0), home - 1))
    blocks = (
        rows.withColumn("_block", F.explode(F.array(*targets)))
        .filter(F.col("_block").isNotNull())
        .withColumn("_own", F.col("_block") == home)
        .withColumn("_pos", F.col("_rn") - F.greatest(F.col("_block") * size - before, F.lit(0)))
        .repartition(*keys, "_block")
    )
    w = Window.partitionBy(*keys, "_block").orderBy("_rn")
    helpers = {"_block", "_own", "_pos", "_rn"} - set(keep)
    return build(blocks, w).filter("_own").drop(*helpers)


def exclusive_prefix(
    totals: DataFrame,
    columns: dict[str, Callable[[Column], Column]],
    key: Keys = "symbol",
    part: str = "_block",
    fan: int = PREFIX_FAN,
) -> DataFrame:
    """Combine each column over all earlier parts of the same key (NULL for the first part).

    ``columns`` maps a column to its combining aggregate (``F.sum``, ``F.max``, …).  Parts are
    folded in groups of ``fan`` and the groups again, so that a key with very many parts is
    never one sort.  "Latest" values use ``F.max`` of a struct that starts with the position.
    """
    keys = _keys(key)
    # Both levels read the same shuffle of the totals: the upper one orders by the last part of a
    # group, so that it needs the same columns, and the filter is the one that the join below would
    # add on one side only; with both, Spark reuses the exchange and runs what is under it once.
    groups = totals.withColumn("_group", F.floor(F.col(part) / fan))
    for c in [*keys, "_group"]:
        groups = groups.filter(F.col(c).isNotNull())
    groups = groups.repartition(*keys, "_group")
    inside = Window.partitionBy(*keys, "_group").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy("_last").rowsBetween(Window.unboundedPreceding, -1)
    upper = (
        groups.groupBy(*keys, "_group")
        .agg(F.max(part).alias("_last"), *[f(F.col(c)).alias(c) for c, f in columns.items()])
        .select(*keys, "_group", *[f(F.col(c)).over(across).alias(f"_up_{c}") for c, f in columns.items()])
    )

    def merged(c: str, f: Callable[[Column], Column]) -> Column:
        low, up = F.col(f"_in_{c}"), F.col(f"_up_{c}")
        both = low + up if f is F.sum else F.greatest(low, up)
        return F.coalesce(both, low, up).alias(c)

    return (
        groups.select(*keys, part, "_group", *[f(F.col(c)).over(inside).alias(f"_in_{c}") for c, f in columns.items()])
        .join(upper, [*keys, "_group"])
        .select(*keys, part, *[merged(c, f) for c, f in columns.items()])
    )


def running_sum(
    df: DataFrame,
    value: Callable[[WindowSpec], Column],
    out: str,
    before: int = 0,
    key: Keys = "symbol",
    order: str = "date",
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Cumulative sum of ``value(w)`` from the start of each series."""

    def build(blocks: DataFrame, w: WindowSpec) -> DataFrame:
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        return blocks.withColumn("_v", value(w)).withColumn(
            "_local", F.sum(F.when(F.col("_own"), F.col("_v"))).over(upto)
        )

    return _with_carry(df, build, "_v", F.sum, lambda local, carry: local + F.coalesce(carry, F.lit(0)), out, before, key, order, size)


def running_max(
    df: DataFrame, column: str, out: str, key: Keys = "symbol", order: str = "date", size: int = BLOCK_ROWS
) -> DataFrame:
    """Largest value of ``column`` from the start of each series up to the row."""

    def build(blocks: DataFrame, w: WindowSpec) -> DataFrame:
        return blocks.withColumn("_v", F.col(column)).withColumn(
            "_local", F.max("_v").over(w.rowsBetween(Window.unboundedPreceding, 0))
        )

    return _with_carry(df, build, "_v", F.max, lambda local, carry: F.greatest(local, carry), out, 0, key, order, size)


def forward_fill(
    df: DataFrame, columns: Sequence[str], key: Keys = "symbol", order: str = "date", size: int = BLOCK_ROWS
) -> DataFrame:
    """Replace NULL by the latest earlier value of the same series."""
    keys = _keys(key)

    def build(blocks: DataFrame, w: WindowSpec) -> DataFrame:
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        return blocks.withColumns({f"_f_{c}": F.last(c, ignorenulls=True).over(upto) for c in columns})

    rows = number_rows(df, keys, order)
    filled = windowed(rows, build, key=keys, order=order, size=size, keep=("_block",))
    latest = rows.groupBy(*keys, F.floor(F.col("_rn") / size).alias("_block")).agg(
        *[F.max(F.when(F.col(c).isNotNull(), F.struct("_rn", c))).alias(f"_p_{c}") for c in columns]
    )
    carry = exclusive_prefix(latest, {f"_p_{c}": F.max for c in columns}, keys)
    return (
        filled.join(carry, [*keys, "_block"], "left")
        .withColumns({c: F.coalesce(F.col(f"_f_{c}"), F.col(f"_p_{c}.{c}")) for c in columns})
        .select(*df.columns)
    )


def _with_carry(df, build, value, combine, merge, out, before, key, order, size) -> DataFrame:
    keys = _keys(key)
    rows = windowed(df, build, before=before, key=keys, order=order, size=size, keep=("_block",))
    totals = rows.groupBy(*keys, "_block").agg(combine(F.col(value)).alias("_carry"))
    carry = exclusive_prefix(totals, {"_carry": combine}, keys)
    return (
        rows.join(carry, [*keys, "_block"])
        .withColumn(out, merge(F.col("_local"), F.col("_carry")))
        .drop("_v", "_local", "_carry", "_block")
    )
