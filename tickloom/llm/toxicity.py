"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has a probability from the weights of its words, and the document's is the
noisy-or of its sentences, ``1 - prod(1 - p)``. Only document labels are learned from, yet the weights end up on words,
so that the sentences which make a document toxic can be named. Words that are not clearly commoner in toxic documents
get no weight, so the model is a short list of words however large the corpus is.

Edge cases: null and empty texts have no sentence and score 0.0. Labels that are null, or that belong to no document,
are not learned from; an id labelled more than once counts as toxic if any of its labels says so. Without labelled
documents of both kinds no word has a weight and every score is close to 0. Repeated rows get equal scores. Texts are
read whole, and memory in a task grows with one batch of texts only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import documents, fold_of

WORD = re.compile(r"[^\W\d_]+")
STOP = re.compile(r"[.!?\n]+")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence, in code points."""
    spans, start = [], 0
    for stop in STOP.finditer(text):
        if stop.start() > start:
            spans.append((start, stop.start()))
        start = stop.end()
    if start < len(text):
        spans.append((start, len(text)))
    return spans


def sentence_words(text: str | None) -> list[set[str]]:
    """The distinct lower-case words of each sentence that has any."""
    found = (set(WORD.findall(sentence)) for sentence in STOP.split((text or "").lower()))
    return [words for words in found if words]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -12.0

    def log_odds(self, words: set[str]) -> float:
        return self.bias + sum(self.weights[w] for w in sorted(words & self.weights.keys()))

    def score(self, text: str | None) -> float:
        z = [self.log_odds(words) for words in sentence_words(text)]
        return float(-np.expm1(-np.logaddexp(0.0, z).sum())) if z else 0.0

    def offending(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """Start, end and probability of the sentences with at least that probability, most likely first."""
        found = []
        for start, end in sentence_spans(text or ""):
            words = set(WORD.findall(text[start:end].lower()))
            p = 1.0 / (1.0 + np.exp(-self.log_odds(words))) if words else 0.0
            if p >= least:
                found.append((start, end, float(p)))
        return sorted(found, key=lambda x: (-x[2], x[0]))


def training_sample(docs: DataFrame, labels: DataFrame, *, per_class: int, max_chars: int, folds: int, held_out: int) -> DataFrame:
    """Bounded sample of labelled documents, ``doc_id, text, toxic``: by a hash of id and text, twice as many clean as toxic ones.

    The bound is on rows: equal rows are taken once, and rows that share an id are rows of their own.
    """
    marked = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), folds) != held_out))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    usable = docs.where(F.length("text") <= max_chars).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    rows = usable.select("doc_id", "key").join(marked, "doc_id").select("key", "toxic").distinct()
    toxic = rows.where("toxic = 1").orderBy("key").limit(per_class)
    clean = rows.where("toxic = 0").orderBy("key").limit(2 * per_class)
    return usable.join(F.broadcast(toxic.union(clean)), "key").dropDuplicates(["key"]).select("doc_id", "text", "toxic")  # at most 3 * per_class keys


def _bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        bags = [[" ".join(sorted(words)) for words in sentence_words(text)] for text in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "bags": bags})


def fit(
    docs: DataFrame, labels: DataFrame, *, per_class: int = 2500, max_chars: int = 20_000, folds: int = 5, held_out: int = 0,
    least_z: float = 2.3, lean: float = 3.0, steps: int = 200, rate: float = 0.1, ridge: float = 1e-4,
) -> Model:
    """Learn word weights from labelled documents outside the fold ``held_out``.

    The sample is bounded: ``per_class`` toxic and twice as many clean documents, of at most ``max_chars`` characters
    each (longer ones are scored, but not learned from). A word is a feature if it is in three sampled documents and
    the z-score of its log-odds for the toxic ones reaches ``least_z``; weights stay positive. A toxic document counts
    ``lean`` times.
    """
    sample = training_sample(docs, labels, per_class=per_class, max_chars=max_chars, folds=folds, held_out=held_out)
    rows = sample.mapInPandas(_bags, "doc_id long, toxic int, bags array<string>").toPandas()
    rows = rows[rows["bags"].map(len) > 0].sort_values("doc_id", kind="stable")
    y = rows["toxic"].to_numpy(np.float64)
    if len(rows) == 0 or y.min() == y.max():
        return Model()
    vocabulary: dict[str, int] = {}
    sentences = [[vocabulary.setdefault(w, len(vocabulary)) for w in bag.split(" ")] for bags in rows["bags"] for bag in bags]
    doc = np.repeat(np.arange(len(y)), rows["bags"].map(len))
    column = np.concatenate([np.asarray(s, np.int64) for s in sentences])
    sentence = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    of_doc, of_word = np.divmod(np.unique(doc[sentence] * len(vocabulary) + column), len(vocabulary))
    seen = np.bincount(of_word, minlength=len(vocabulary))
    toxic = np.bincount(of_word, y[of_doc], minlength=len(vocabulary))
    clean = seen - toxic
    odds = np.log((toxic + 0.5) / (y.sum() - toxic + 0.5)) - np.log((clean + 0.5) / (len(y) - y.sum() - clean + 0.5))
    chosen = np.flatnonzero((seen >= 3) & (odds / np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5)) >= least_z))
    place = np.full(len(vocabulary), -1)
    place[chosen] = np.arange(len(chosen))
    sentence, column = sentence[place[column] >= 0], place[column[place[column] >= 0]]
    w, b = np.zeros(len(chosen)), float(-np.log(4 * len(sentences) / y.sum()))
    slope_w, square_w, slope_b, square_b = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        z = b + np.bincount(sentence, w[column], minlength=len(sentences))
        p_doc = np.clip(-np.expm1(-np.bincount(doc, np.logaddexp(0.0, z), minlength=len(y))), 1e-6, 1.0)
        pull = np.where(y > 0, -lean * (1.0 - p_doc) / p_doc, 1.0) / len(y)
        slope = pull[doc] / (1.0 + np.exp(-np.clip(z, -30, 30)))
        gw, gb = np.bincount(column, slope[sentence], minlength=len(w)) + ridge * w, slope.sum()
        slope_w, square_w = 0.9 * slope_w + 0.1 * gw, 0.999 * square_w + 0.001 * gw * gw
        slope_b, square_b = 0.9 * slope_b + 0.1 * gb, 0.999 * square_b + 0.001 * gb * gb
        scale = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        w = np.maximum(w - scale * slope_w / (np.sqrt(square_w) + 1e-8), 0.0)
        b -= scale * slope_b / (np.sqrt(square_b) + 1e-8)
    words = list(vocabulary)
    return Model({words[k]: float(x) for k, x in zip(chosen, w) if x > 0}, float(b))


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(text) for text in texts], dtype="float64")

    return docs.withColumn(name, score(F.col("text")))


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """One row for each sentence that is toxic by itself: ``doc_id, start, end, probability``; code points, end exclusive."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, *x) for i, t in zip(batch["doc_id"], batch["text"]) for x in model.offending(t, least)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "probability"])

    return docs.select("doc_id", "text").mapInPandas(find, "doc_id long, start int, end int, probability double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = with_score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = fold_of(F.col("doc_id"), 5) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
