"""Periodic runs of words, by longest common extensions over a difference cover.

A run is a stretch of consecutive words whose smallest period is ``q`` (words ``q`` apart are identical), at least
``max(MIN_WORDS, MIN_PERIODS * q)`` words long, that no neighbouring word extends. ``with_runs`` finds all runs of a text and
the text without the repetitions: a word goes if a run holds it after that run's first ``q`` words.

Enumeration walks a harmonic grid: for each period ``q`` only the positions 0, q, 2q, ... are compared with the word ``q``
further on, n/q of them, n log n in all. A run of four periods holds three neighbouring grid points that agree; from the
first of them the longest common extensions to the right and to the left give the whole run, and the search goes on behind it.

Extensions are answered by ``CoverLce``. Positions modulo ``COVER_SIZE`` that lie in a difference cover are sampled (6 in 31).
Only the sampled suffixes are sorted, by their first words and then by prefix doubling, and the common prefixes of
neighbours in that order go into a sparse table. For any two positions some shift below 31 makes both sampled: a query compares
the words before that shift and then takes one range minimum.

Documents of a batch are laid end to end, a word of its own between any two, so that numpy works on about ``CHUNK_WORDS`` words
at once; a longer document is a chunk by itself. The memory of a task is bounded by a batch and the longest text.

Edge cases: null and empty texts have no runs; the collapsed text of null is null, of a text without words empty. White space between
words is written as one space. Every row is judged by itself, so ties, repeated rows and null ids need no rule; of two periods with the
same extent only the smaller is a run. Other columns are kept whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import SPACE, documents, text_of

MIN_WORDS, MIN_PERIODS = 6, 4
CHUNK_WORDS = 1 << 20
#: Every number below 31 is the difference, modulo 31, of two of these.
COVER_SIZE, COVER = 31, (1, 5, 11, 24, 25, 27)

FOUND = T.StructType().add("runs", T.ArrayType(T.StructType().add("start", "long").add("length", "long").add("period", "long"))).add("collapsed", "string")
RUNS = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _shifts() -> np.ndarray:
    """For residues i and j the smallest shift that brings both into the cover."""
    inside = np.isin(np.arange(2 * COVER_SIZE) % COVER_SIZE, COVER)
    table = np.zeros((COVER_SIZE, COVER_SIZE), np.int64)
    for i in range(COVER_SIZE):
        for j in range(COVER_SIZE):
            table[i, j] = np.flatnonzero(inside[i : i + COVER_SIZE] & inside[j : j + COVER_SIZE])[0]
    return table


SHIFTS = _shifts()
SLOT = np.searchsorted(COVER, np.arange(COVER_SIZE))


class CoverLce:
    """Longest common extensions to the right. ``words`` are not negative, but for words that occur once, and end in one such."""

    def __init__(self, words: np.ndarray) -> None:
        size = -(-len(words) // COVER_SIZE) * COVER_SIZE
        ends = np.arange(size + COVER_SIZE - len(words), dtype=np.int32) + np.iinfo(np.int32).min
        self.words = np.concatenate([words.astype(np.int32), ends])
        self.positions = (np.arange(0, size, COVER_SIZE)[:, None] + np.asarray(COVER)).ravel()
        levels = self._sorted_samples()
        self.rank = levels[-1]
        self.minima = self._range_minima(levels)

    def _sorted_samples(self) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by their first 31, 62, 124, ... words, until all differ."""
        first = np.lib.stride_tricks.sliding_window_view(self.words.view(np.uint32), COVER_SIZE)[self.positions]
        whole = np.ascontiguousarray(first.astype(">u4")).view(np.dtype((np.void, 4 * COVER_SIZE))).ravel()
        rank = np.unique(whole, return_inverse=True)[1].astype(np.int64)
        levels, step, count = [rank], len(COVER), len(rank)
        while rank.max() + 1 < count:
            after = np.zeros(count, np.int64)
            after[: count - step] = rank[step:] + 1
            rank = np.unique(rank * (count + 1) + after, return_inverse=True)[1].astype(np.int64)
            levels.append(rank)
            step *= 2
        return levels

    def _range_minima(self, levels: list[np.ndarray]) -> np.ndarray:
        """Common prefixes of neighbouring sampled suffixes, and their minima over 1, 2, 4, ... neighbours."""
        order = np.argsort(levels[-1])
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        last = len(order) - 1
        for depth in reversed(range(len(levels) - 1)):
            same = levels[depth][np.minimum(a, last)] == levels[depth][np.minimum(b, last)]
            same &= (a <= last) & (b <= last)
            a, b = a + same * (len(COVER) << depth), b + same * (len(COVER) << depth)
            common += same * (COVER_SIZE << depth)
        i, j = self.positions[order[:-1]] + common, self.positions[order[1:]] + common
        common += self._compared(i, j, np.full(len(i), COVER_SIZE))[0]
        table = [common.astype(np.int32)]
        width = 1
        while 2 * width <= len(common):
            low = table[-1].copy()
            low[: len(low) - width] = np.minimum(low[:-width], low[width:])
            table.append(low)
            width *= 2
        return np.stack(table)

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal words from ``i`` and ``j`` on, ``most`` at most, and whether it was that many."""
        equal, live = np.zeros(len(i), np.int64), np.arange(len(i))
        for k in range(int(most.max(initial=0))):
            live = live[most[live] > k]
            live = live[self.words[i[live] + k] == self.words[j[live] + k]]
            equal[live] += 1
        return equal, equal == most

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` and from ``j`` on are equal, for each pair of different positions."""
        shift = SHIFTS[i % COVER_SIZE, j % COVER_SIZE]
        equal, synchronised = self._compared(i, j, shift)
        at = np.flatnonzero(synchronised)
        if len(at):
            ranks = [self.rank[(p // COVER_SIZE) * len(COVER) + SLOT[p % COVER_SIZE]] for p in (i[at] + shift[at], j[at] + shift[at])]
            low, high = np.minimum(*ranks), np.maximum(*ranks)
            depth = np.frexp((high - low).astype(np.float64))[1] - 1
            equal[at] += np.minimum(self.minima[depth, low], self.minima[depth, high - (1 << depth)])
        return equal


def streaks(words: np.ndarray, longest: int) -> np.ndarray:
    """Rows ``period, first, last``: grid points, at least three in a row, whose words agree with those a period further on."""
    found = []
    for q in range(1, longest // MIN_PERIODS + 1):
        agree = words[:-q:q] == words[q::q]
        if len(agree) < 3:
            break
        three = agree[:-2] & agree[1:-1] & agree[2:]
        if three.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[0], three.view(np.int8), [0]])))
            begins, ends = edges[::2], edges[1::2]
            found.append(np.stack([np.full(len(begins), q), begins * q, (ends + 1) * q], axis=1))
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def runs_of(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows ``start, length, period`` of all runs, in this order, counted from the beginning of ``words``.

    ``words`` are documents one after another, with a negative word of its own before the first and after each; ``bounds``
    are the positions of these.
    """
    lengths = np.diff(bounds) - 1
    seen = streaks(words, int(lengths.max(initial=0)))
    if not len(seen):
        return np.empty((0, 3), np.int64)
    # only documents with a streak are sorted: they are laid end to end once more
    held = np.zeros(len(lengths) + 1, np.int64)
    np.add.at(held, np.searchsorted(bounds, seen[:, 1], side="right") - 1, 1)
    np.add.at(held, np.searchsorted(bounds, seen[:, 2] + seen[:, 0], side="right"), -1)
    held = np.cumsum(held)[:-1] > 0
    place = np.repeat(held, lengths + 1)  # a document with the word before it
    some = np.concatenate([words[:-1][place], words[-1:]])
    where = np.cumsum(np.concatenate([[0], place])).astype(np.int64)  # of a position, or of the next one held
    right, left = CoverLce(some), CoverLce(some[::-1])
    q, at, last = seen.T
    found = []
    while len(q):
        i, j = where[at], where[at + q]
        after = right.extend(i, j)
        before = left.extend(len(some) - i, len(some) - j)
        found.append(np.stack([at - before, before + after + q, q], axis=1))
        at = ((at + after) // q + 1) * q  # the grid point after the first word that disagrees
        on = at + 2 * q <= last
        q, at, last = q[on], at[on], last[on]
    runs = np.concatenate(found)
    runs = runs[runs[:, 1] >= np.maximum(MIN_WORDS, MIN_PERIODS * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    smallest = np.ones(len(runs), bool)
    smallest[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)  # a multiple of the period has the same extent
    runs = runs[smallest]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _chunk(texts: list[list[bytes]]) -> tuple[list[np.ndarray], list[bytes]]:
    """Runs and collapsed text of each document, given by its words."""
    numbers = _Numbers()
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    words = np.empty(bounds[-1] + 1, np.int32)
    inside = np.ones(len(words), bool)
    inside[bounds] = False
    words[bounds] = -1 - np.arange(len(bounds))
    words[inside] = np.fromiter(map(numbers.__getitem__, chain.from_iterable(texts)), np.int32, len(words) - len(bounds))
    runs = runs_of(words, bounds)
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(dropped)[:-1] == 0
    document = np.searchsorted(bounds, runs[:, 0]) - 1
    own, collapsed = [], []
    cuts = np.searchsorted(document, np.arange(len(texts) + 1))
    for k, text in enumerate(texts):
        first = bounds[k] + 1
        mine = runs[cuts[k] : cuts[k + 1]] - [first, 0, 0]
        own.append(mine)
        if len(mine):
            text = [text[p] for p in np.flatnonzero(kept[first : first + len(text)])]
        collapsed.append(b" ".join(text))
    return own, collapsed


def found_in(texts: Iterable[bytes | None]) -> Iterator[tuple[np.ndarray, bytes | None]]:
    """Runs and collapsed text of each text, read in chunks."""

    def done(waiting: list[list[bytes] | None]) -> Iterator[tuple[np.ndarray, bytes | None]]:
        known = [w for w in waiting if w is not None]
        results = iter(zip(*_chunk(known))) if known else iter(())
        for words in waiting:
            yield (np.empty((0, 3), np.int64), None) if words is None else next(results)

    waiting, size = [], 0
    for text in texts:
        words = None if text is None else text.split()  # bytes: splits at ASCII white space only
        more = len(words or ())
        if waiting and size + more > CHUNK_WORDS:
            yield from done(waiting)
            waiting, size = [], 0
        waiting.append(words)
        size += more
    if waiting:
        yield from done(waiting)


def _found(texts: pa.Array) -> pa.Array:
    own, collapsed = zip(*found_in(v.as_py() for v in texts.cast(pa.large_binary()))) if len(texts) else ((), ())
    starts = np.concatenate([[0], np.cumsum([len(r) for r in own])]).astype(np.int32)
    flat = np.concatenate([*own, np.empty((0, 3), np.int64)])
    runs = pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(RUNS)))
    return pa.StructArray.from_arrays([runs, pa.array(collapsed, pa.binary()).cast(pa.string())], ["runs", "collapsed"])


def _with_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("row"), _found(batch.column("text"))], ["row", "found"])


def with_runs(rows: DataFrame, text: Column, name: str = "periodic", keep: list[str] | None = None) -> DataFrame:
    """``rows`` with a struct: ``runs``, ordered by start and period, in word numbers from 0; ``collapsed``, the text without repetitions.

    ``keep`` names the columns to keep, by default all.
    """
    kept = F.struct(*(["*"] if keep is None else [F.col(f"`{c}`") for c in keep])).alias("row")
    dealt = rows.select(kept, text.alias("text"))
    kind = T.StructType([dealt.schema["row"], T.StructField("found", FOUND)])
    return dealt.mapInArrow(_with_found, kind).select("row.*", F.col("found").alias(name))


def planted(doc_id: Column, text: Column) -> Column:
    """The text, or for one id in ten its words with a period of their own from some word on; nothing is changed without an id."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))

        def bound(s: Column) -> Column:
            source = lambda i: F.when(i >= s["a"], s["a"] + (i - s["a"]) % s["p"]).otherwise(i)
            return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, source(i).cast("int"))), " ")

        return F.when(n > 0, F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), bound)[0]).otherwise(text)

    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    return F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(text)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact ratio of length to period; of equal ones the first. Null without runs."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(more(best, r), r).otherwise(best))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = documents(spark, sf_dir).select("doc_id", planted(F.col("doc_id"), text_of()).alias("text"))
    found = with_runs(texts, F.col("text"), keep=["doc_id"]).select("doc_id", "periodic.runs", "periodic.collapsed")
    found = found.withColumn("best", strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
