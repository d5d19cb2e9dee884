"""Language-model scores: a hashed maximum-entropy model over corpus counts.

Corpus counts cover every training document and give the base score. The model gives the probability of the next token
from hashed features: the word before, the two before together, the second word before alone, and a constant. Its softmax
is factored: first the class of a token, then its class within that one, and so on to the token. All common words have a
place, and so have the end of a text and any other word; another word has that one's probability times its share of the
counts of all other words. A class has as many parts as the vocabulary asks for: three levels of its cube root, or two
of ``CLASSES`` where those hold it. Weights come from rounds of gradient steps: each task starts from the weights so far
and steps through its texts, and Spark averages what the tasks have changed.

Counts of common words, at most ``1 / COMMON`` of them whatever the corpus, go to the tasks; the rare words of a text are
looked up by a join with the count table.

Edge cases: null and empty texts are the end token alone. Repeated rows get equal scores. Without training documents
all counts are 0 and both scores are those of the smoothed counts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import documents, fold_of
from tickloom.session import written

#: White space ends words, so this is no word.
END = b"\n"
CLASSES = 32
#: Words with at least this share of all tokens are common.
COMMON = 1e-6
#: Least rows of the weight tables; they follow the vocabulary up to ``MOST_ROWS``, which a worker can hold.
CLASS_ROWS, WORD_ROWS, MOST_ROWS = 1 << 14, 1 << 16, 1 << 18
FEATURES = 4
SMOOTH = 0.1
#: Suffixes of rare words are told apart by so many slots, as features.
SUFFIXES = 512
BATCH = 8192


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text; ``bytes.lower`` and ``bytes.split`` know ASCII letters and white space only, as asked for."""
    return (text or b"").lower().split()


def counts(docs: DataFrame, flush: int = 500_000) -> DataFrame:
    """``word, n`` over all texts, the end of a text included. Tasks add up what they hold before it is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                held.update(words_of(text))
                held[END] += 1
                if len(held) > flush:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Ids(dict):
    """Numbers of common words, by falling count; rare words get a negative number from their suffix."""

    def __missing__(self, word: bytes) -> int:
        return -1 - zlib.crc32(word[-2:]) % SUFFIXES


@dataclass
class Vocabulary:
    """Common words and the end of a text with their counts, most frequent first, and the totals of the corpus."""

    words: list[bytes]
    n: np.ndarray
    tokens: int
    distinct: int

    def __post_init__(self) -> None:
        self.ids = _Ids((w, k) for k, w in enumerate(self.words))
        # 0 is the end, 1 any other word
        self.inner = 2 + np.arange(len(self.words))
        self.inner[self.ids[END] + 1 :] -= 1
        self.inner[self.ids[END]] = 0
        self.others = self.tokens - int(self.n.sum())
        self.other_words = self.distinct - int((self.n > 0).sum())

    @property
    def inner_size(self) -> int:
        return len(self.words) + 1

    @property
    def base_total(self) -> float:
        return math.log10(self.tokens + SMOOTH * (self.distinct + 1))

    @property
    def other_total(self) -> float:
        return math.log10(self.others + SMOOTH * (self.other_words + 1))


def vocabulary(table: DataFrame) -> Vocabulary:
    tokens, distinct = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    rows = table.where((F.col("n") >= max(1.0, COMMON * tokens)) | (F.col("word") == F.lit(END))).toArrow().to_pandas()
    rows = rows.sort_values(["n", "word"], ascending=[False, True], kind="stable")
    words, n = [bytes(w) for w in rows["word"]], rows["n"].to_numpy(np.int64)
    return Vocabulary(words, n, tokens, distinct) if END in words else Vocabulary([END], np.zeros(1, np.int64), tokens, distinct)


def _sums(keys: np.ndarray, values: np.ndarray, few: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, rising, the sum of each one's rows of ``values``, and their number.

    ``reduceat`` works column by column, a call for each key, so it is left the keys that have more than ``few`` rows. The
    others take their rows one by one.
    """
    # keys and places in one number: these sort faster, and equal keys keep their order
    bits = len(keys).bit_length()
    ordered = np.sort((keys << bits) | np.arange(len(keys)))
    order = ordered & ((1 << bits) - 1)
    ordered >>= bits
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    n = np.diff(np.append(starts, len(ordered)))
    if len(starts) == 1:
        return ordered[:1], np.ones((1, len(values)), np.float32) @ values, n
    total = values.take(order[starts], 0)
    more = np.flatnonzero((n > 1) & (n <= few))
    for k in range(1, few):
        more = more[n[more] > k]
        if not len(more):
            break
        total[more] += values.take(order[starts[more] + k], 0)
    many = n > few
    if many.any():
        total[many] = np.add.reduceat(values.take(order[np.repeat(many, n)], 0), np.cumsum(n[many]) - n[many])
    return ordered[starts], total, n


@dataclass
class Weights:
    """Rows of log-weights: of classes by feature, and of the parts of a class, on ``depth - 1`` levels, by feature and class."""

    classes: np.ndarray
    places: np.ndarray
    depth: int = 2

    @staticmethod
    def zero(tokens: int = CLASSES**2) -> Weights:
        """Weights for so many different tokens."""
        depth, width = 2, CLASSES
        if tokens > width**depth:
            depth = 3
            while width**depth < tokens:
                width += 1
        size = lambda least, n: min(MOST_ROWS, max(least, 1 << int(n).bit_length()))
        return Weights(np.zeros((size(CLASS_ROWS, tokens // 4), width), np.float32), np.zeros((size(WORD_ROWS, tokens), width), np.float32), depth)

    def levels(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Table, hashed rows of each token's features, and the part that holds the token, from the first level to the last.

        Features are the word before, the second before, both, a constant.
        """
        a, b = (one + SUFFIXES + 3).astype(np.uint64), (two + SUFFIXES + 3).astype(np.uint64)
        mixed = np.stack([a * np.uint64(0x9E3779B97F4A7C15), b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1), a * np.uint64(0x165667B19E3779F9) ^ b * np.uint64(0x27D4EB2F165667C5), np.full(len(a), 7, np.uint64)], 1)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        width = self.classes.shape[1]
        for level in range(self.depth):
            upper, part = np.divmod(target // width ** (self.depth - 1 - level), width)
            table, rows = self.classes, mixed
            if level:
                table, held = self.places, (upper * self.depth + level - 1).astype(np.uint64)
                rows = (mixed + held[:, None] * np.uint64(0x94D049BB133111EB)) * np.uint64(0x9E3779B97F4A7C15)
            yield table, ((rows >> np.uint64(40)) % np.uint64(len(table))).astype(np.int64), part

    @staticmethod
    def _softmax(table: np.ndarray, rows: np.ndarray, most: float = 60.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, their powers and the sums of these; less each row's largest logit where a power might leave single precision."""
        z = table.take(rows[:, 0], 0)
        for k in range(1, FEATURES):
            z += table.take(rows[:, k], 0)
        if z.max() > most or z.min() < -most:
            z -= z.max(1, keepdims=True)
        e = np.exp(z)
        return z, e, e @ np.ones(e.shape[1], np.float32)

    def log_p(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural logarithm of each token's probability."""
        out = np.zeros(len(target))
        for at in range(0, len(target), BATCH):
            part = slice(at, at + BATCH)
            every = np.arange(len(target[part]))
            for table, rows, wanted in self.levels(one[part], two[part], target[part]):
                z, _, total = self._softmax(table, rows)
                out[part] += z[every, wanted] - np.log(total)
        return out

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One gradient step over a batch of tokens; each row moves by its mean slope over the square root of its uses."""
        slopes = []
        for table, rows, wanted in self.levels(one, two, target):
            _, slope, total = self._softmax(table, rows)
            slope *= (1 / total)[:, None]
            slope[np.arange(len(wanted)), wanted] -= 1.0
            slopes.append((table, rows, slope))
        for table, rows, slope in slopes:
            for k in range(FEATURES):
                used, total, n = _sums(rows[:, k], slope)
                total *= (-rate / 4 / np.sqrt(n)).astype(np.float32)[:, None]
                total += table.take(used, 0)
                whole = f"V{table[0].nbytes}"  # a row as one item
                np.put(table.view(whole), used, total.view(whole))


def contexts(texts: list[bytes | None], vocab: Vocabulary) -> tuple[np.ndarray, ...]:
    """All tokens of some texts in a row: number, number before, second before, inner number; and each text's length."""
    ids, sizes = [], []
    end, number = vocab.ids[END], vocab.ids.__getitem__
    for text in texts:
        words = words_of(text)
        ids += map(number, words)
        ids.append(end)
        sizes.append(len(words) + 1)
    token, size = np.array(ids, np.int64), np.array(sizes, np.int64)
    first = np.cumsum(size) - size
    start = -2 - SUFFIXES  # before a text
    one, two = np.append(start, token[:-1]), np.append([start, start], token[:-2])[: len(token)]
    one[first] = start
    two[first] = start
    two[(first + 1)[size > 1]] = start
    inner = np.where(token >= 0, vocab.inner[np.maximum(token, 0)], 1)
    return token, one, two, inner, size


def _stretches(texts: list[bytes | None], most: int = 2_000_000) -> Iterator[list[int]]:
    """Numbers of texts whose bytes together stay near ``most``."""
    held, size = [], 0
    for k, text in enumerate(texts):
        held.append(k)
        size += len(text or b"")
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def share_of(docs: DataFrame, turn: int, shares: int) -> DataFrame:
    """One of ``shares`` parts of the rows, told apart by a hash of id and text; every row is in one of them."""
    return docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit("lm")), F.lit(shares)) == turn)


def train(docs: DataFrame, vocab: Vocabulary, *, rounds: int = 2, one_in: int | None = None, docs_per_task: int = 40_000, rate: float = 0.5) -> Weights:
    """Rounds of gradient steps. Each round reads one in ``one_in`` of all texts, other ones each time, in whole.

    Without ``one_in`` the rounds together read every text once.

    The tasks grow in number with the documents. A task's changes are sums of its steps; rows are averaged over the
    tasks that changed them. What comes back is the weights' size, whatever the input.
    """
    weights = Weights.zero(vocab.inner_size)
    class_rows, width = weights.classes.shape
    tasks = 1 + docs.count() // docs_per_task
    context = docs.sparkSession.sparkContext
    for turn in range(rounds):
        sent = context.broadcast((vocab, weights))
        mine = share_of(docs, turn, one_in or rounds).select("text").coalesce(tasks)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
            words, begun = sent.value
            now = Weights(begun.classes.copy(), begun.places.copy(), begun.depth)
            for batch in batches:
                texts = batch.column(0).cast(pa.binary()).to_pylist()
                for some in _stretches(texts):
                    _, one, two, inner, _ = contexts([texts[k] for k in some], words)
                    for at in range(0, len(inner), BATCH):
                        part = slice(at, at + BATCH)
                        now.step(one[part], two[part], inner[part], rate)
            for shift, new, old in ((0, now.classes, begun.classes), (class_rows, now.places, begun.places)):
                changed = np.flatnonzero((new != old).any(1))
                change = (new - old)[changed]
                rows = [pa.array(changed + shift, pa.int32()), pa.array([r.tobytes() for r in change], pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, names=["row", "change"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for batch in batches:
                for row, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    entry = total.setdefault(row, [np.zeros(width, np.float32), 0])
                    entry[0] += np.frombuffer(raw, np.float32)
                    entry[1] += 1
            rows = [pa.array(total.keys(), pa.int32()), pa.array([(s / n).tobytes() for s, n in total.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(rows, names=["row", "change"])

        changes = mine.mapInArrow(learn, "row int, change binary").repartition("row").mapInArrow(average, "row int, change binary").toArrow()
        for batch in changes.to_batches():  # a row has one change; the driver holds them once, and a batch of them as an array
            rows = batch.column(0).to_numpy()
            change = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, width)
            weights.classes[rows[rows < class_rows]] += change[rows < class_rows]
            weights.places[rows[rows >= class_rows] - class_rows] += change[rows >= class_rows]
        del changes
        sent.unpersist()
    return weights


def partly_scored(docs: DataFrame, vocab: Vocabulary, weights: Weights) -> DataFrame:
    """Each document with what its common words and the model give, and its rare words with their counts."""
    sent = docs.sparkSession.sparkContext.broadcast((vocab, weights))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = sent.value
        common = np.log10(words.n + SMOOTH)
        rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))
        for batch in batches:
            every, all_ids = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("doc_id").to_pylist()
            for some in _stretches(every):
                token, one, two, inner, size = contexts([every[k] for k in some], words)
                of = np.repeat(np.arange(len(some)), size)
                known = token >= 0
                counted = np.where(known, common[np.maximum(token, 0)], 0.0)
                met = known & (words.n[np.maximum(token, 0)] > 0)
                model_p = model.log_p(one, two, inner) / math.log(10)
                total = lambda x: np.bincount(of, x, minlength=len(some))
                rare = []
                for k, lost in zip(some, np.split(~known, np.cumsum(size)[:-1])):
                    text = words_of(every[k])
                    rare.append([{"word": w, "n": n} for w, n in Counter([text[i] for i in np.flatnonzero(lost)]).items()])
                columns = [
                    pa.array([all_ids[k] for k in some], pa.int64()), pa.array(size), pa.array(total(met).astype(np.int64)), pa.array(total(counted)),
                    pa.array(total(~known).astype(np.int64)), pa.array(total(model_p)), pa.array(rare, rare_type),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "common", "counted", "others", "model", "rare"])

    schema = "doc_id long, n_tokens long, common long, counted double, others long, model double, rare array<struct<word:binary,n:int>>"
    return docs.select("doc_id", "text").mapInArrow(score, schema)


def scored(docs: DataFrame, table: DataFrame, vocab: Vocabulary, weights: Weights) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every row of ``docs``."""
    parts = written(partly_scored(docs, vocab, weights).withColumn("row", F.monotonically_increasing_id()), "lm-parts")
    least = max(1.0, COMMON * vocab.tokens)
    rare = parts.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    found = rare.join(table.where((F.col("n") < least) & (F.col("word") != F.lit(END))), "word", "left")
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("counted_rare"),
    )
    joined = parts.drop("rare").join(sums, "row", "left")
    counted_rare = F.coalesce("counted_rare", F.lit(0.0))
    base = F.col("counted") + counted_rare - F.col("n_tokens") * vocab.base_total
    score = F.col("model") + counted_rare - F.col("others") * vocab.other_total
    return joined.select("doc_id", "n_tokens", (F.col("common") + F.coalesce("known", F.lit(0))).alias("n_known"), base.alias("base_score"), score.alias("score"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = fold_of(F.col("doc_id"), 10) == 0
    learned = docs.where(~held_out)
    table = written(counts(learned), "lm-counts")
    vocab = vocabulary(table)
    rows = scored(docs, table, vocab, train(learned, vocab))
    return rows.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(vocab.tokens).cast("long").alias("train_tokens"), "base_score", "score")
