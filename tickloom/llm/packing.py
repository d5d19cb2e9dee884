"""Packing documents into fixed windows by minimum bin slack.

A document is its token ids and an end id. Whole windows are cut from its front; what is left is shorter than a window.
The lengths of these rests are counted, at most ``capacity - 1`` counts however many documents there are, and windows are
planned on the counts: each plan starts with the longest rest and fills the window by a subset-sum dynamic programme over
the other lengths, as bit sets, which is walked back into how many rests of each length it takes. A plan is repeated as
long as its lengths last, so there are at most as many plans as lengths. Rests then get their place from their rank among
rests of the same length, without any of them passing through the driver.

Edge cases: null and empty texts are documents of the end id alone. Repeated rows and equal or null ids are packed as
separate documents. An empty table has no pieces. One length may hold any share of the rows: ranks are taken in salted
groups and put together from the groups' sizes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import documents
from tickloom.llm.tokens import Encoder, byte_encoder
from tickloom.session import written

CAPACITY = 2048
END_ID = 1
#: Documents whose pieces leave a task together.
EMIT = 500
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())]
)


def cut(encoder: Encoder, text: str | None, capacity: int = CAPACITY) -> list[tuple[int, bytes]]:
    """Pieces of a document's ids with the end id, ``start, ids``: whole windows, then the rest."""
    ids = np.append(encoder.encode(text), np.uint32(END_ID)).astype("<u4")
    return [(start, ids[start : start + capacity].tobytes()) for start in range(0, len(ids), capacity)]


def with_pieces(docs: DataFrame, encoder: Encoder, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, ids, doc_tokens, number``; ids as little-endian 32-bit integers, or null.

    ``number`` tells rows apart that are equal otherwise.
    A task holds a batch of texts and the pieces of ``EMIT`` of them.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, EMIT):
                part, rows = batch.slice(at, EMIT), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = cut(encoder, text, capacity)
                    total = sum(len(raw) for _, raw in found) // 4
                    rows += [(doc_id, start, len(raw) // 4, zlib.crc32(raw), raw if keep_ids else None, total) for start, raw in found]
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SCHEMA)], schema=SCHEMA)

    schema = "doc_id long, start long, length long, ids_crc32 long, ids binary, doc_tokens long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, schema).withColumn("number", F.monotonically_increasing_id())


@dataclass(frozen=True)
class Plan:
    """``times`` windows that each hold ``take[length]`` rests of a length, longest first."""

    take: dict[int, int]
    times: int


def fill(room: int, available: dict[int, int]) -> dict[int, int]:
    """How many of each length fill ``room`` as far as possible.

    Bit i of a set is on if a sum of i can be reached. Counts are split into powers of two, so a length costs a few
    shifts; the sets before each step are kept to walk back from the largest sum.
    """
    reached, steps = 1, []
    for length in sorted(available, reverse=True):
        left = min(available[length], room // length)
        part = 1
        while left > 0:
            n = min(part, left)
            steps.append((length, n, reached))
            reached |= (reached << (length * n)) & ((1 << (room + 1)) - 1)
            left, part = left - n, part * 2
        if reached >> room & 1:
            break
    total, taken = reached.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> total & 1:  # the sum needs this step
            taken[length] = taken.get(length, 0) + n
            total -= length * n
    return taken


def plans(counts: dict[int, int], capacity: int = CAPACITY) -> list[Plan]:
    """Windows for rests of the given counts by length, each as full as its first, longest rest allows."""
    left, made = {k: v for k, v in counts.items() if v > 0}, []
    while left:
        first = max(left)
        others = {k: v - (k == first) for k, v in left.items() if v > (k == first)}
        take = fill(capacity - first, others)
        take[first] = take.get(first, 0) + 1
        times = min(left[k] // n for k, n in take.items())
        made.append(Plan(dict(sorted(take.items(), reverse=True)), times))
        for k, n in take.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return made


@dataclass(frozen=True)
class Places:
    """Where the rank of a rest among those of its length leads: intervals of (length, rank) in order."""

    length: np.ndarray
    first_rank: np.ndarray
    per_window: np.ndarray
    window: np.ndarray
    offset: np.ndarray
    windows: int

    @staticmethod
    def of(made: list[Plan]) -> Places:
        used: dict[int, int] = {}
        rows, window = [], 0
        for plan in made:
            offset = 0
            for length, n in plan.take.items():
                rows.append((length, used.get(length, 0), n, window, offset))
                used[length] = used.get(length, 0) + n * plan.times
                offset += length * n
            window += plan.times
        columns = np.asarray(sorted(rows), np.int64).reshape(-1, 5).T
        return Places(*columns, window)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and offset of rests."""
        width = int(max(self.first_rank.max(), rank.max(), 0)) + 1 if len(rank) else 1
        k = np.searchsorted(self.length * width + self.first_rank, length * width + rank, side="right") - 1
        turn, place = np.divmod(rank - self.first_rank[k], self.per_window[k])
        return self.window[k] + turn, self.offset[k] + place * length


def ranked(pieces: DataFrame, by: str, salts: int) -> DataFrame:
    """``pieces`` with a gapless ``rank`` from 0 among equal ``by``; a group is ordered in ``salts`` parts, which are put end to end."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "number"), F.lit(salts)))
    inside = salted.withColumn("inside", F.row_number().over(Window.partitionBy(by, "salt").orderBy("doc_id", "start", "ids_crc32", "number")) - 1)
    sizes = salted.groupBy(by, "salt").count()  # lengths x salts rows
    before = F.coalesce(F.sum("count").over(Window.partitionBy(by).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(by, "salt", before.alias("before"))
    return inside.join(starts, [by, "salt"]).withColumn("rank", F.col("before") + F.col("inside")).drop("salt", "inside", "before")


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``pieces`` is read several times: give a written table."""
    salts = max(16, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    counts.pop(capacity, None)  # whole windows need no plan
    places = Places.of(plans(counts, capacity))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            sequence, offset = rank + places.windows, np.zeros(len(batch), np.int64)
            rest = length < capacity
            sequence[rest], offset[rest] = places.find(length[rest], rank[rest])
            yield batch.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"
    return ranked(pieces, "length", salts).select(*pieces.columns, "rank").mapInPandas(place, schema).drop("number")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = with_pieces(documents(spark, sf_dir).select("doc_id", "text"), byte_encoder()).drop("ids")
    return packed(written(pieces, "pieces")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
