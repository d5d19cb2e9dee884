"""Recurrences over the whole history of daily series, all in one pass over the rows.

Exponential averages, the MACD signal (an average of the difference of two averages), Wilder-style averages of rises and
falls, and on-balance volume are one state that moves from row to row. Within a calendar chunk of a key
every value is a running sum of weighted values from a zero state. A zero state in place of the true one is off by an affine map that
depends on nothing but the number of rows in between, so the true state before a chunk follows from one row per chunk: how
many rows it has, the state it ends with, and its first and last closes. These rows are folded in order, a row's value is its chunk's plus the
map of the state before, and the position of the row in its series comes along.

So the rows are shuffled once, by key and chunk, and written once to the shared folder; what they come from is read once.
A key has at most as many chunks as the calendar, whatever the number of its rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.operators.averages import block_rows
from tickloom.operators.series import CHUNK_DAYS, Keys, _keys
from tickloom.session import written

CLOSE, VOLUME = "close", "volume"


@dataclass(frozen=True)
class State:
    """What moves from row to row.

    ``averages`` maps a name to (column, span); ``signal`` is (name, fast, slow, span), the average of the difference of two of them, started
    at zero; ``moves`` is the span of the averages ``_g`` and ``_l`` of rises and falls of the close; ``obv`` adds on-balance volume.
    """

    averages: Mapping[str, tuple[str, int]] = field(default_factory=dict)
    signal: tuple[str, str, str, int] | None = None
    moves: int | None = None
    obv: bool = False

    @property
    def spans(self) -> dict[str, int]:
        """Spans of all averages but the signal."""
        return {o: s for o, (_, s) in self.averages.items()} | ({"_g": self.moves, "_l": self.moves} if self.moves else {})

    @property
    def names(self) -> list[str]:
        return [*self.spans, *([self.signal[0]] if self.signal else []), *(["OBV"] if self.obv else [])]

    @property
    def closes(self) -> bool:
        """Whether neighbouring closes matter."""
        return self.obv or self.moves is not None

    def columns(self) -> list[str]:
        return list(dict.fromkeys([*[c for c, _ in self.averages.values()], *([CLOSE] if self.closes else []), *([VOLUME] if self.obv else [])]))

    def chunk(self) -> int:
        """Days of a chunk: as many rows as the weights of all averages allow."""
        spans = [*self.spans.values(), *([self.signal[3]] if self.signal else [])]
        if any(s < 2 for s in spans):
            raise ValueError("the average of span 1 is the value itself")
        return block_rows(spans, CHUNK_DAYS) if spans else CHUNK_DAYS


def _kept(span: int) -> float:
    return 1 - 2 / (span + 1)


def _power(span: int, n: Column) -> Column:
    return F.pow(F.lit(_kept(span)), n.cast("double"))


def _value(column: str) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.raise_error(F.lit(f"{column} is NULL: fill it before averaging")).cast("double"))


def _signed(before: Column, close: Column, volume: Column) -> Column:
    return F.when(close > before, volume).when(close < before, -volume).otherwise(0).cast("bigint")


def local(rows: DataFrame, state: State, w: WindowSpec) -> DataFrame:
    """``_pos``, the place in the window's partition, and ``_l_<name>``: each value from a zero state before the partition."""
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_pos", F.row_number().over(w) - 1)

    def average(value: Column, span: int) -> Column:
        return F.sum(value * (2 / (span + 1)) * _power(span, -F.col("_pos"))).over(upto) * _power(span, F.col("_pos"))

    inputs = {}
    if state.closes:
        close, before = F.col(CLOSE), F.lag(CLOSE, 1).over(w)
        rise = F.when(F.col("_pos") > 0, _value(CLOSE) - before)
        if state.moves:
            inputs |= {"_up": F.when(rise > 0, rise).otherwise(0.0), "_down": F.when(rise < 0, -rise).otherwise(0.0)}
        if state.obv:
            inputs["_signed"] = _signed(before, close, F.col(VOLUME))
    rows = rows.withColumns(inputs) if inputs else rows
    values = {f"_l_{o}": average(_value(c), s) for o, (c, s) in state.averages.items()}
    if state.moves:
        values |= {"_l__g": average(F.col("_up"), state.moves), "_l__l": average(F.col("_down"), state.moves)}
    if state.obv:
        values["_l_OBV"] = F.sum("_signed").over(upto)
    rows = rows.withColumns(values) if values else rows
    if state.signal:
        name, fast, slow, span = state.signal
        rows = rows.withColumn(f"_l_{name}", average(F.col(f"_l_{fast}") - F.col(f"_l_{slow}"), span))
    return rows.drop(*inputs)


def _coupled(state: State, n: Column, of: str) -> Column:
    """How much of an average before ``n`` rows is in the signal after them."""
    span = state.signal[3]
    share, q, p = 2 / (span + 1), _kept(span), _kept(state.spans[of])
    if p == q:
        return F.lit(share) * n * _power(span, n)
    return F.lit(share * p / (q - p)) * (_power(span, n) - _power(state.spans[of], n))


def _after(state: State, n: Column, own: Mapping[str, Column], before: Mapping[str, Column]) -> dict[str, Column]:
    """Values ``n`` rows after the state ``before``, where ``own`` are those from a zero state."""
    out = {o: own[o] + _power(s, n) * before[o] for o, s in state.spans.items()}
    if state.signal:
        name, fast, slow, span = state.signal
        out[name] = own[name] + _power(span, n) * before[name] + _coupled(state, n, fast) * before[fast] - _coupled(state, n, slow) * before[slow]
    if state.obv:
        out["OBV"] = own["OBV"] + before["OBV"]
    return out


def _before(chunks: DataFrame, state: State, keys: list[str]) -> DataFrame:
    """For each chunk the rows before it, ``_start``, and the state before it, ``_c_<name>``, the move to its first close included."""
    names = state.names
    held = chunks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_chunk", "_n", "_first", "_last"))).alias("_x"))
    zero = {o: F.lit(0).cast("bigint") if o == "OBV" else F.lit(0.0) for o in names}
    kind = ", ".join(["_chunk: bigint", "_start: bigint", *[f"_c_{o}: {'bigint' if o == 'OBV' else 'double'}" for o in names]])
    empty = F.struct(
        F.lit(0).cast("bigint").alias("start"), F.lit(None).cast("double").alias("close"), *[zero[o].alias(o) for o in names],
        F.array().cast(f"array<struct<{kind}>>").alias("seen"),
    )

    def add(s: Column, x: Column) -> Column:
        first = s["start"] == 0
        carry = {o: s[o] for o in names}
        for o, (column, _) in state.averages.items():
            carry[o] = F.when(first, x["_first"][column].cast("double")).otherwise(s[o])  # started at the first value
        if state.closes:
            close = x["_first"][CLOSE].cast("double")
            rise = F.when(first, 0.0).otherwise(close - s["close"])
            if state.moves:
                share = 2 / (state.moves + 1) / _kept(state.moves)
                carry["_g"] = s["_g"] + share * F.greatest(rise, F.lit(0.0))
                carry["_l"] = s["_l"] + share * F.greatest(-rise, F.lit(0.0))
            if state.obv:
                carry["OBV"] = s["OBV"] + F.coalesce(F.when(first, 0).otherwise(_signed(s["close"], close, x["_first"][VOLUME])), F.lit(0)).cast("bigint")
        after = _after(state, x["_n"], {o: x["_last"][f"_l_{o}"] for o in names}, carry)
        seen = F.struct(x["_chunk"].alias("_chunk"), s["start"].alias("_start"), *[carry[o].alias(f"_c_{o}") for o in names])
        return F.struct(
            (s["start"] + x["_n"]).alias("start"),
            (x["_last"][CLOSE].cast("double") if state.closes else F.lit(None).cast("double")).alias("close"),
            *[after[o].alias(o) for o in names], F.concat(s["seen"], F.array(seen)).alias("seen"),
        )

    return held.select(*keys, F.explode(F.aggregate("_x", empty, add, lambda s: s["seen"])).alias("_y")).select(*keys, "_y.*")


def _settled(state: State, values: Mapping[str, Column], first: Column) -> dict[str, Column]:
    """The first row of a series has its own value as average and no signal, without a rounding error."""
    exact = {o: F.col(c).cast("double") for o, (c, _) in state.averages.items()}
    if state.signal:
        exact[state.signal[0]] = F.lit(0.0)
    return {o: F.when(first, exact[o]).otherwise(v) if o in exact else v for o, v in values.items()}


def with_state(rows: DataFrame, state: State, key: Keys = "symbol", order: str = "date") -> DataFrame:
    """``rows`` with a column for each name of the state, and ``_rn``, the 0-based position in the series.

    ``order`` is a date unique per key. A NULL in an averaged column is an error: fill it first.
    """
    keys, days = _keys(key), state.chunk()
    dealt = rows.withColumn("_chunk", F.floor(F.unix_date(order) / days)).repartition(*keys, "_chunk")
    held = written(local(dealt, state, Window.partitionBy(*keys, "_chunk").orderBy(order)), "history")
    ends = F.struct(*[f"_l_{o}" for o in state.names], *([CLOSE] if state.closes else []))
    first = F.struct(*(state.columns() or ["_pos"]))
    if not state.names:
        ends = F.struct("_pos")
    chunks = held.groupBy(*keys, "_chunk").agg(
        F.count("*").alias("_n"), F.min_by(first, "_pos").alias("_first"), F.max_by(ends, "_pos").alias("_last")
    )
    out = held.join(_before(chunks, state, keys), [*keys, "_chunk"])  # at most a chunk's rows for a key of this join
    values = _after(state, F.col("_pos") + 1, {o: F.col(f"_l_{o}") for o in state.names}, {o: F.col(f"_c_{o}") for o in state.names})
    position = F.col("_start") + F.col("_pos")
    return out.withColumns({**_settled(state, values, position == 0), "_rn": position}).select(*rows.columns, *state.names, "_rn")


def with_state_bounded(rows: DataFrame, state: State, key: Keys = "symbol", order: str = "date") -> DataFrame:
    """The same for keys of at most ``state.chunk()`` rows, such as a tail: windows by key, no numbering, nothing written."""
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy(order)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = {o: F.lit(0).cast("bigint") if o == "OBV" else F.lit(0.0) for o in state.names}
    done = local(rows, state, w).withColumns({f"_c_{o}": F.first(c).over(every).cast("double") for o, (c, _) in state.averages.items()})
    before = zero | {o: F.col(f"_c_{o}") for o in state.averages}
    values = _after(state, F.col("_pos") + 1, {o: F.col(f"_l_{o}") for o in state.names}, before)
    return done.withColumns({**_settled(state, values, F.col("_pos") == 0), "_rn": F.col("_pos").cast("bigint")}).select(*rows.columns, *state.names, "_rn")
