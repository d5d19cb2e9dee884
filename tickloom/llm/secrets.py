"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

Three patterns find the plain cases. Every further run of key-like characters is a candidate: a small convolutional
network in numpy reads its characters and those around it. It learns from the corpus' own labelled findings, pattern
findings against candidates that no pattern marks; contexts are swapped in training, so that it has to judge the
characters themselves. A bounded sample only gives the weights to start from: the network then steps through every other
labelled candidate of the distinct texts, in shards told apart by a hash of the text, and Spark averages what the shards have
learned. Its scores are calibrated on all labelled candidates whose value it did not train on, and the threshold is the
highest step of 1/64 in its logits that still finds ``least_recall`` of those; the precision there is kept beside it.

Edge cases: null and empty texts have no spans. Spans count code points, ends are exclusive; spans of different kinds may
overlap, a model span never overlaps a pattern span. Candidates longer than the network's view are read in overlapping
views and count by the highest. Without enough labelled findings of both kinds the network adds nothing. Repeated rows
get equal spans.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import documents, fold_of, text_of
from tickloom.session import written

#: The patterns and least lengths of the findings.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: What a text with findings has: one of these in lower case, or so many digits among every fourth character.
NAMES, FOURTHS = ("passw", "secret", "token", "api"), re.compile(r"[0-9a-f]{8}")
KINDS = ("assign", "access", "hex", "model")
#: A candidate is a whole run of key-like characters, of the least length of an assigned value.
LEAST = 8
SIDE, VIEW = 24, 64
#: Code points of texts, views, and views of a learning step that are worked on together.
CHARS, TOGETHER, STEP = 200_000, 128, 256
#: Steps of a logit that are told apart when the threshold is set, and texts in a shard that learns by itself.
STEPS, DOCS_PER_SHARD = 64, 5_000
Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Pattern findings by start, then kind."""
    found, low = [], text.lower()
    if any(name in low for name in NAMES):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    if FOURTHS.search(text[::4]):
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


#: Codes of ASCII characters and, last, of all others; 3 is any other ASCII character.
_CODE = np.append(np.full(0x80, 3, np.uint8), np.uint8(1))
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-:\"' \n@"):
    _CODE[ord(_c)] = 4 + _k
CODES = int(_CODE.max()) + 1
_KEY = np.array([bool(re.match(r"[A-Za-z0-9+/_=.-]", chr(c))) for c in range(0x80)] + [False])
#: Codes of a place before or after a text, and of a place outside a view.
NOTHING, OUTSIDE = 0, 2


POWERS = np.cumprod(np.full(2 * SIDE + VIEW, 0x9E3779B97F4A7C15, np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def coded(seen: list[tuple[str, str, str]]) -> np.ndarray:
    """Character codes of views ``before, value, after``, a row each; codes inside the candidate are raised by ``CODES``."""
    out = np.full((len(seen), 2 * SIDE + VIEW), OUTSIDE, np.int64)
    for row, (left, value, right) in zip(out, seen):
        points = np.frombuffer((left + value + right).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = _CODE[np.minimum(points, 0x80)].astype(np.int64)
        codes[len(left) : len(left) + len(value)] += CODES
        row[: 2 * SIDE + len(value)] = NOTHING
        row[SIDE - len(left) : SIDE - len(left) + len(codes)] = codes
    return out


@dataclass
class Views:
    """What the network sees of candidates, as places in one array of texts with ``SIDE`` empty places around each.

    A view is the candidate's characters and ``SIDE`` before and after them; a candidate longer than ``VIEW`` has several.
    """

    points: np.ndarray
    codes: np.ndarray
    text: np.ndarray  # of each candidate: number of the text, start and end there, whether a span touches it
    start: np.ndarray
    end: np.ndarray
    label: np.ndarray
    candidate: np.ndarray  # of each view: number of the candidate, first place, length of what it sees of it
    at: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(texts: list[str], spans: list[list[Span]]) -> Views:
        gap = "\0" * SIDE
        points = np.frombuffer((gap + "".join(t + gap for t in texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(t) + SIDE for t in texts], np.int64)
        begin = SIDE + np.cumsum(length) - length
        low = np.minimum(points, 0x80)
        codes = _CODE.take(low)
        codes[np.append(begin, len(points))[:, None] - SIDE + np.arange(SIDE)] = NOTHING
        key = np.zeros(len(points) + 2, np.int8)
        key[1:-1] = _KEY.take(low)
        turn = np.diff(key)
        first, last = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        first, last = first[last - first >= LEAST], last[last - first >= LEAST]
        label = np.zeros(len(first), bool)
        for at, found in zip(begin.tolist(), spans):
            for _, a, b in found:
                label[np.searchsorted(last, at + a, side="right") : np.searchsorted(first, at + b)] = True
        text = np.searchsorted(begin, first, side="right") - 1
        long = np.maximum(last - first - VIEW, 0)
        n = np.where(long > 0, long // (VIEW // 2) + 2, 1)
        candidate = np.repeat(np.arange(len(first)), n)
        turn = np.arange(len(candidate)) - np.repeat(np.cumsum(n) - n, n)
        at = first[candidate] + np.minimum(turn * (VIEW // 2), long[candidate])
        origin = begin[text] if len(first) else first
        return Views(points, codes, text, first - origin, last - origin, label, candidate, at, np.minimum(last - first, VIEW)[candidate])

    def places(self, views: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places that some views see, one view after another, with the contexts of other views; which are inside, and each view's first."""
        size = self.size[views]
        length = size + 2 * SIDE
        offset = np.cumsum(length) - length
        k = np.arange(length.sum()) - np.repeat(offset + SIDE, length)
        inside = (k >= 0) & (k < np.repeat(size, length))
        shift = np.repeat(self.at[views], length)
        if context is not views:
            before, after = self.at[context], self.at[context] + self.size[context] - size
            shift = np.where(inside, shift, np.where(k < 0, np.repeat(before, length), np.repeat(after, length)))
        return shift + k, inside, offset

    def seen(self, views: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of views one after another, raised inside, and each view's first place."""
        places, inside, offset = self.places(views, context)
        return self.codes[places] + inside * np.uint8(CODES), offset

    def hashes(self) -> np.ndarray:
        """A number for each view's characters, context included, of 63 bits."""
        if not len(self.at):
            return np.zeros(0, np.uint64)
        views = np.arange(len(self.at))
        places, _, offset = self.places(views, views)
        k = np.arange(len(places)) - np.repeat(offset, self.size + 2 * SIDE)
        held = self.points[places].astype(np.uint64) + (self.codes[places] != NOTHING)
        return mixed(np.add.reduceat(held * POWERS[k], offset) + self.size.astype(np.uint64)) >> np.uint64(1)

    def apart(self) -> np.ndarray:
        """Whether views are kept for calibration, by a hash of the candidate's value: equal values are on one side."""
        if not len(self.at):
            return np.zeros(0, bool)
        length = self.end - self.start
        first = self.at[np.searchsorted(self.candidate, np.arange(len(length)))]
        offset = np.cumsum(length) - length
        k = np.arange(length.sum()) - np.repeat(offset, length)
        held = self.points[np.repeat(first, length) + k].astype(np.uint64) * mixed(k.astype(np.uint64) + np.uint64(1))
        return (mixed(np.add.reduceat(held, offset)) >> np.uint64(62) == 0)[self.candidate]

    def strings(self, view: int) -> tuple[str, str, str]:
        at, end = int(self.at[view]), int(self.at[view] + self.size[view])
        text = lambda a, b: self.points[a:b][self.codes[a:b] != NOTHING].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        return text(at - SIDE, at), text(at, end), text(end, end + SIDE)

    def mates(self) -> np.ndarray:
        """For each view another one of the same text, half of the text's views further, whose context it can be shown with."""
        of = self.text[self.candidate]
        n = np.bincount(of, minlength=1)[of]
        first = np.searchsorted(of, of)
        return first + (np.arange(len(of)) - first + np.maximum(n // 2, 1)) % np.maximum(n, 1)


def candidates(text: str) -> list[tuple[int, int]]:
    found = Views.of([text], [[]])
    return list(zip(found.start.tolist(), found.end.tolist()))


def stretches(texts: Iterator[str]) -> Iterator[list[str]]:
    """Texts in turn, so many that their characters stay near ``CHARS``."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def parts(views: np.ndarray, size: int = TOGETHER) -> Iterator[np.ndarray]:
    return (views[k : k + size] for k in range(0, len(views), size))


@dataclass
class Network:
    """Embedding, one convolution, the maximum over places, and a logistic output with calibration."""

    embed: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 2.0
    precision: float = 0.0
    WIDTH = 5

    @staticmethod
    def fresh(seed: int, dims: int = 8, channels: int = 24) -> Network:
        rng = np.random.default_rng(seed)
        size = Network.WIDTH * dims
        return Network(rng.normal(0, 0.5, (2 * CODES, dims)), rng.normal(0, size**-0.5, (size, channels)), np.zeros(channels), rng.normal(0, 0.2, channels), np.zeros(1))

    def _forward(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        seen = np.lib.stride_tricks.sliding_window_view(codes, self.WIDTH, axis=1)
        x = self.embed[seen].reshape(*seen.shape[:2], -1)
        h = np.where((seen == OUTSIDE).any(2)[:, :, None], -np.inf, x @ self.filters + self.shift)
        best = h.argmax(1)
        top = np.maximum(np.take_along_axis(h, best[:, None], 1)[:, 0], 0.0)
        return seen, x, best, top, top @ self.out + self.bias[0]

    def _taps(self) -> np.ndarray:
        """The convolution of embedded codes is a sum of rows of one table for each tap."""
        dims = self.embed.shape[1]
        taps = np.stack([self.embed @ self.filters[k * dims : (k + 1) * dims] for k in range(self.WIDTH)]).astype(np.float32)
        taps[:, OUTSIDE] = -1e4
        return taps

    def _responses(self, taps: np.ndarray, codes: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each place's response, each view's maximum, and where a view's places end."""
        places, codes = len(codes) - self.WIDTH + 1, codes.astype(np.int64)
        h, more = taps[0].take(codes[:places], axis=0), None
        for k in range(1, self.WIDTH):
            more = np.take(taps[k], codes[k : k + places], axis=0, out=more, mode="clip")
            h += more
        return self._highest(h, len(codes), offset)

    def _highest(self, h: np.ndarray, n: int, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        end = np.append(offset[1:], n) - self.WIDTH + 1
        bounds = np.stack([offset, end], 1).ravel()[:-1]
        return h, np.maximum.reduceat(h, bounds, axis=0)[::2], end

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The taps for scores: the first and the next two by pairs of codes, and the last."""
        taps = self._taps()
        pairs = [(taps[k][:, None] + taps[k + 1][None]).reshape(-1, taps.shape[2]) for k in (0, 2)]
        return *pairs, taps[4]

    def scores(self, codes: np.ndarray, offset: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
        """Logits of views one after another."""
        one, two, last = tables
        places, codes = len(codes) - self.WIDTH + 1, codes.astype(np.int64)
        pairs = codes[:-1] * len(last) + codes[1:]
        h = one.take(pairs[:places], axis=0)
        more = two.take(pairs[2 : 2 + places], axis=0)
        h += more
        h += np.take(last, codes[4:], axis=0, out=more, mode="clip")
        return np.maximum(self._highest(h, len(codes), offset)[1] + self.shift, 0.0) @ self.out + self.bias[0]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        """Logits of a row of codes each."""
        tables = self.tables()
        parts_ = []
        for at in range(0, len(codes), 64):
            some = codes[at : at + 64]
            parts_.append(self.scores(some.ravel(), np.arange(len(some)) * codes.shape[1], tables))
        return np.concatenate(parts_) if parts_ else np.zeros(0)

    def slopes(self, codes: np.ndarray, offset: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
        """Slopes of the weighted loss of views one after another, for each array of weights."""
        taps = self._taps()
        h, highest, end = self._responses(taps, codes, offset)
        top = np.maximum(highest + self.shift, 0.0)
        dz = (1.0 / (1.0 + np.exp(-np.clip(top @ self.out + self.bias[0], -40, 40))) - y) * weight
        dtop = dz[:, None] * self.out * (top > 0)
        length = np.append(offset[1:], len(h)) - offset
        h[(end[:-1, None] + np.arange(self.WIDTH - 1)).ravel()] = np.inf  # places across two views
        row, channel = np.divmod(np.flatnonzero(h == np.repeat(highest, length, axis=0)), h.shape[1])
        view = np.repeat(np.arange(len(offset)), length)[row]
        place = np.zeros(highest.shape, np.int64)
        place[view[::-1], channel[::-1]] = row[::-1]  # the first of equals
        # a tap's table moves in the row of the code that it met at the place of the maximum
        channels, dims = top.shape[1], self.embed.shape[1]
        d_filters, d_embed = np.zeros_like(self.filters), np.zeros_like(self.embed)
        for k in range(self.WIDTH):
            met = codes[place + k].astype(np.int64) * channels + np.arange(channels)
            d_tap = np.bincount(met.ravel(), dtop.ravel(), minlength=len(self.embed) * channels).reshape(-1, channels)
            d_filters[k * dims : (k + 1) * dims] = self.embed.T @ d_tap
            d_embed += d_tap @ self.filters[k * dims : (k + 1) * dims].T
        return d_embed, d_filters, dtop.sum(0), dz @ top, np.array([dz.sum()])

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.shift, self.out, self.bias]

    def with_weights(self, flat: np.ndarray) -> Network:
        ends = np.cumsum([w.size for w in self.weights])
        return Network(*[p.reshape(w.shape).copy() for p, w in zip(np.split(flat, ends[:-1]), self.weights)])

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.logits(codes) + self.offset, -40, 40)))

    def train(self, codes: np.ndarray, y: np.ndarray, *, epochs: int, seed: int, rate: float = 0.01) -> None:
        rng, move = np.random.default_rng(seed), Moves(self, rate)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), 64):
                rows = order[at : at + 64]
                seen, x, best, top, z = self._forward(codes[rows])
                dz = (1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))) - y[rows]) / len(rows)
                dtop = dz[:, None] * self.out * (top > 0)
                picked = np.take_along_axis(x, best[:, :, None], 1)  # row, channel, input
                d_filters = np.einsum("bc,bci->ic", dtop, picked)
                d_picked = dtop[:, :, None] * self.filters.T  # row, channel, input
                d_embed = np.zeros_like(self.embed)
                places = np.take_along_axis(seen, best[:, :, None], 1)
                np.add.at(d_embed, places, d_picked.reshape(*places.shape, -1))
                move((d_embed, d_filters, dtop.sum(0), dz @ top, np.array([dz.sum()])))

    def calibrate(self, codes: np.ndarray, y: np.ndarray, least_recall: float) -> None:
        """Platt scaling, then the highest threshold with the recall asked for, and the precision on the same findings."""
        self.calibrate_counts(self.logits(codes), y, np.ones(len(y)), least_recall)

    def calibrate_counts(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, least_recall: float) -> None:
        """The same from logits and labels that ``n`` findings each have."""
        a, b = 1.0, 0.0
        positive, total = float(n[y > 0].sum()), float(n.sum())
        target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (total - positive + 2))
        for _ in range(500):
            p = 1.0 / (1.0 + np.exp(-np.clip(a * z + b, -40, 40)))
            a -= 0.05 * float(((p - target) * z) @ n / total) / max(1.0, float((z * z) @ n / total))
            b -= 0.05 * float((p - target) @ n / total)
        self.slope, self.offset = max(a, 1e-3), b
        p = 1.0 / (1.0 + np.exp(-np.clip(self.slope * z + self.offset, -40, 40)))
        order = np.argsort(p[y > 0], kind="stable")
        missed = np.cumsum(n[y > 0][order])
        self.threshold = float(p[y > 0][order][np.searchsorted(missed, int((1 - least_recall) * positive), side="right")])
        self.precision = float(n[(p >= self.threshold) & (y > 0)].sum() / n[p >= self.threshold].sum())


class Moves:
    """Adaptive gradient steps of a network's weights."""

    def __init__(self, network: Network, rate: float) -> None:
        self.values, self.rate, self.step = network.weights, rate, 0
        self.first, self.second = [np.zeros_like(v) for v in self.values], [np.zeros_like(v) for v in self.values]

    def __call__(self, slopes: tuple[np.ndarray, ...]) -> None:
        self.step += 1
        for v, m, s, g in zip(self.values, self.first, self.second, slopes):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            v -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.999**self.step)) + 1e-8)


def found_in(texts: list[str]) -> Views:
    """Candidates, labelled 1 if a pattern finding touches them, else 0."""
    return Views.of(texts, [base_spans(t) for t in texts])


def labelled(docs: DataFrame, per_label: int, folds: int, held_out: int) -> pd.DataFrame:
    """A bounded sample of labelled candidates from all texts outside a fold: the ``per_label`` smallest hashes of each label, copies once.

    A task gives the smallest that it meets; the smallest of all are among them.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[set[tuple]] = [set(), set()]
        most = [1 << 63, 1 << 63]
        for some in stretches(t for batch in batches for t in batch["text"] if t):
            views = found_in(some)
            h = views.hashes()
            label = views.label[views.candidate]
            for y in (0, 1):
                few = np.flatnonzero((label == y) & (h <= np.uint64(most[y])))
                if len(few) > per_label:  # no more than that can be among the smallest, copies apart
                    few = few[np.unique(h[few], return_index=True)[1][:per_label]]
                held[y].update((int(h[v]), y, *views.strings(v)) for v in few)
                if len(held[y]) > 2 * per_label:
                    held[y] = set(sorted(held[y])[:per_label])
                    most[y] = max(held[y])[0]
        yield pd.DataFrame(list(held[0] | held[1]), columns=["h", "label", "before", "value", "after"])

    learned = docs.where(fold_of(F.col("doc_id"), folds) != held_out).select("text")
    found = learned.mapInPandas(find, "h long, label int, before string, value string, after string").dropDuplicates()
    found = written(found, "labelled")  # read once for each label
    columns = "label", "before", "value", "after"
    top = [found.where(F.col("label") == y).orderBy("h", *columns).limit(per_label).select(*columns).toPandas() for y in (0, 1)]
    return pd.concat(top, ignore_index=True)


def learned_from(docs: DataFrame, network: Network, fill: np.ndarray, *, seed: int, rate: float = 0.0005) -> Network:
    """The network after steps through all labelled candidates of the distinct texts that are not for calibration.

    Texts are dealt to shards by hash and read in order of it, so that the result does not hang on how they are stored. Every
    shard starts from the same weights; Spark averages them, weighed by candidates. Findings of patterns are rare:
    ``fill``, rows of codes of some, are shown between a shard's own, and both labels weigh the same in a step.
    """
    shards = 1 + docs.count() // DOCS_PER_SHARD
    h = F.xxhash64("text")
    dealt = docs.select(F.pmod(h, F.lit(shards)).alias("shard"), h.alias("h"), "text")
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "h", "text").select("shard", "text")
    shown, length = fill[fill != OUTSIDE].astype(np.uint8), (fill != OUTSIDE).sum(1)
    shown_at = np.cumsum(length) - length

    def steps(views: Views, now: Network, move: Moves, rng: np.random.Generator) -> int:
        label, mate = views.label[views.candidate], views.mates()
        mine = rng.permutation(np.flatnonzero(~views.apart()))
        for some in parts(mine, STEP):
            mates = np.where(rng.random(len(some)) < 0.5, mate[some], some)  # so that the context alone can't decide
            codes, offset = views.seen(some, mates)
            y = label[some].astype(np.float64)
            more = rng.choice(len(shown_at), min(len(shown_at), max(0, len(some) // 8 - int(y.sum()))), replace=False)
            codes = np.concatenate([codes, *[shown[shown_at[k] : shown_at[k] + length[k]] for k in more]])
            offset = np.concatenate([offset, views.size[some].sum() + 2 * SIDE * len(some) + np.cumsum(length[more]) - length[more]]).astype(np.int64)
            y = np.concatenate([y, np.ones(len(more))])
            n = np.array([(y == 0).sum(), (y > 0).sum()])
            move(now.slopes(codes, offset, y, 0.5 / np.maximum(n, 1)[y.astype(np.int64)]))
        return len(mine)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((s, t) for batch in batches for s, t in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist()))
        for shard, mine in itertools.groupby(rows, key=lambda r: r[0]):
            now = network.with_weights(np.concatenate([w.ravel() for w in network.weights]))
            move, rng = Moves(now, rate), np.random.default_rng([seed, shard])
            n = 0
            for some in stretches(t for t, _ in itertools.groupby(t for _, t in mine)):  # copies once
                n += steps(found_in(some), now, move, rng)
            flat = np.concatenate([w.ravel() for w in now.weights])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat * n), pa.array(np.full(len(flat), n), pa.int64())], names=["place", "weight", "n"])

    sums = dealt.mapInArrow(learn, "place int, weight double, n long").groupBy("place").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))
    found = sums.toPandas().sort_values("place")
    return network.with_weights((found["weight"] / found["n"]).to_numpy()) if len(found) and found["n"].min() > 0 else network


def calibrated(docs: DataFrame, network: Network, least_recall: float) -> Network | None:
    """The network with its threshold set on all labelled candidates kept for that, each with its own context and another one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held = network.tables(), Counter()
        for some in stretches(t for batch in batches for t in batch.column("text").to_pylist()):
            views = found_in(some)
            label, mate = views.label[views.candidate], views.mates()
            for few in parts(np.flatnonzero(views.apart())):
                for context in (few, mate[few]):
                    z = np.floor(STEPS * np.clip(network.scores(*views.seen(few, context), tables), -1000, 1000)).astype(np.int64)
                    held.update(zip(z.tolist(), label[few].tolist()))
        columns = [pa.array([z for z, _ in held], pa.int64()), pa.array([int(y) for _, y in held], pa.int32()), pa.array(held.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["z", "y", "n"])

    found = docs.select("text").mapInArrow(count, "z long, y int, n long").groupBy("z", "y").agg(F.sum("n").alias("n")).toPandas().sort_values(["z", "y"])
    n = found.groupby("y")["n"].sum()
    if min(n.get(0, 0), n.get(1, 0)) < 3:
        return None
    network.calibrate_counts(found["z"].to_numpy() / STEPS, found["y"].to_numpy(np.float64), found["n"].to_numpy(np.float64), least_recall)
    return network


def fit(docs: DataFrame, *, per_label: int = 1500, epochs: int = 4, least_recall: float = 0.95, folds: int = 5, held_out: int = 0, seed: int = 7) -> Network | None:
    """Start from ``per_label`` labelled candidates of either kind, learn from and calibrate on all; None if there are fewer than 20 of one."""
    rows = labelled(docs, per_label, folds, held_out)
    seen = list(zip(rows["before"], rows["value"], rows["after"]))
    y = rows["label"].to_numpy(np.float64)
    # a view shows a part of a long candidate, whose whole may be for calibration: only short ones give weights to start from
    start = np.array([len(v) < VIEW and not Views.of([v], [[]]).apart().any() for _, v, _ in seen], bool)
    if min(y.sum(), len(y) - y.sum()) < 20 or min(y[start].sum(), (1 - y[start]).sum()) < 3:
        return None
    rng = np.random.default_rng(seed)
    other = rng.permutation(len(seen))
    swapped = [(seen[o][0], v[1], seen[o][2]) for v, o in zip(seen, other)]  # so that the context alone can't decide
    network = Network.fresh(seed)
    first = np.flatnonzero(start)
    network.train(coded([seen[k] for k in first] + [swapped[k] for k in first]), np.concatenate([y[first]] * 2), epochs=epochs, seed=seed)
    learned = docs.where((fold_of(F.col("doc_id"), folds) != held_out) & (F.length(text_of()) > 0))
    network = learned_from(learned, network, coded([seen[k] for k in first if y[k] > 0]), seed=seed)
    return calibrated(learned, network, least_recall)


def all_spans(texts: list[str], network: Network | None) -> list[list[Span]]:
    """Pattern spans of each text and, apart from those, candidates that the network accepts."""
    if network is None:
        return [base_spans(t) for t in texts]
    out, tables = [], network.tables()
    for some in stretches(texts):
        found = [base_spans(t) for t in some]
        views = Views.of(some, found)
        accepted = np.zeros(len(views.start), bool)
        for few in parts(np.flatnonzero(~views.label[views.candidate])):
            z = network.scores(*views.seen(few, few), tables)
            p = 1.0 / (1.0 + np.exp(-np.clip(network.slope * z + network.offset, -40, 40)))
            accepted[views.candidate[few[p >= network.threshold]]] = True
        for k in np.flatnonzero(accepted):
            found[views.text[k]].append(("model", int(views.start[k]), int(views.end[k])))
        out += [sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))) for spans in found]
    return out


def spans_of(network: Network | None, text: Column) -> Column:
    """Spans of a text as array of ``kind, start, end``."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        found = all_spans([t or "" for t in texts], network)
        return pd.Series([[dict(zip(("kind", "start", "end"), s)) for s in one] for one in found])

    return spans(text)


def redact(text: str, spans: list[Span], by: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover replaced."""
    parts, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if start >= at:
            parts += [text[at:start], by]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redacted(network: Network | None, text: Column) -> Column:
    """A text without its secrets; null stays null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        found = all_spans([t or "" for t in texts], network)
        return pd.Series([t if t is None else redact(t, s) for t, s in zip(texts, found)], dtype=object)

    return clean(text)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = docs.select("doc_id", spans_of(fit(docs), F.col("text")).alias("found"))
    count = [_count(F.col("found"), kind).alias(f"n_{kind}") for kind in KINDS]
    base = F.filter("found", lambda s: s["kind"] != "model")
    return found.select("doc_id", *count[:3], F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), count[3])
