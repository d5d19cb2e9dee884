"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of one to three characters of lower-case text, white space as one blank, by language and hash slot; counting runs in
the tasks and is summed by Spark, so only the matrix of languages and slots reaches the driver. It is sent to the tasks
as log-probabilities, and numpy scores each text of a batch by the slots that it has, a sparse product.

Edge cases: null texts and texts without a letter are ``und`` with score 0.0, and so is every text if nothing was
learned. Null languages are not learned from. Ties go to the language that sorts first. Repeated rows get equal results.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import documents, fold_of

BITS = 15
SLOTS = 1 << BITS
UNKNOWN = "und"
#: Texts are hashed in stretches of so many characters, to bound memory; two characters are read again for the n-grams across.
STRETCH = 1 << 20
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_BLANK = np.array([c <= 0x7F and not chr(c).isalpha() for c in range(0x110)])


def slots(text: str) -> np.ndarray:
    """Hash slots of all n-grams: one, two and three characters; everything in ASCII that is no letter counts as a blank."""
    found = []
    for start in range(0, len(text), STRETCH):
        part = text[max(0, start - 2) : start + STRETCH].lower()
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(_BLANK[np.minimum(points, 0x10F)], np.uint32(32), points)
        points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]  # runs of blanks count once
        one = (points + np.uint32(1)) * _MIX[0]
        two = (one[:-1] ^ (points[1:] * _MIX[1])) * _MIX[2]
        three = (two[:-1] ^ (points[2:] * _MIX[1])) * _MIX[0]
        found += [x >> np.uint32(32 - BITS) for x in (one, two, three)]
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def has_letter(text: str) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_p: np.ndarray  # slots x languages
    prior: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """A language and its posterior."""
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        used, counts = np.unique(slots(text), return_counts=True)
        z = self.prior + counts @ self.log_p[used]
        best = int(z.argmax())
        return self.languages[best], float(1.0 / np.exp(z - z[best]).sum())


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of one task, a row for each language; sums of all its texts."""
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"]):
            if lang not in total:
                total[lang] = np.zeros(SLOTS, np.int64)
            total[lang] += np.bincount(slots(text), minlength=SLOTS)
            docs[lang] = docs.get(lang, 0) + 1
    for lang, counts in total.items():
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "slot": np.append(used, -1), "n": np.append(counts[used], docs[lang])})


def fit(docs: DataFrame, *, per_language: int = 4000, most_languages: int = 500, folds: int = 3, held_out: int = 1, smooth: float = 0.5) -> Model:
    """Learn from about ``per_language`` documents of each language, by a hash of id and text; of every language from one at least.

    The matrix has ``most_languages`` columns at most; more languages are an error, none is dropped silently.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of(F.col("doc_id"), folds) != held_out))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not sizes:
        return Model((), np.zeros((SLOTS, 0)), np.zeros(0))
    # the share of hashes that leaves about per_language documents of a language: no sort, no group in one task
    share = {r["lang"]: min(1.0, per_language / r["n"]) for r in sizes}
    cut = F.create_map([F.lit(x) for lang, s in share.items() for x in (lang, int(s * (1 << 30)))])
    order = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    drawn = usable.where(order < cut[F.col("lang")]).select("text", "lang")

    def counted(rows: DataFrame) -> pd.DataFrame:
        return rows.mapInPandas(_counts, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()

    summed = counted(drawn)
    if missed := sorted(share.keys() - set(summed["lang"])):  # rows that are all alike can all have large hashes
        first = usable.where(F.col("lang").isin(missed)).groupBy("lang").agg(F.min_by("text", order).alias("text"))
        summed = pd.concat([summed, counted(first.select("text", "lang"))])
    languages = tuple(sorted(share))
    counts = np.zeros((SLOTS, len(languages)))
    column = summed["lang"].map({lang: k for k, lang in enumerate(languages)}).to_numpy()
    grams = summed["slot"].to_numpy() >= 0
    counts[summed["slot"].to_numpy()[grams], column[grams]] = summed["n"].to_numpy()[grams]
    all_docs = np.array([next(r["n"] for r in sizes if r["lang"] == lang) for lang in languages], float)
    log_p = np.log(counts + smooth) - np.log(counts.sum(0) + smooth * SLOTS)
    return Model(languages, log_p, np.log(all_docs / all_docs.sum()))


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``language``: ``lang_pred`` and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS x languages, whatever the input

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def language(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sent.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn("language", language(F.col("text")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    named = with_language(docs.select("doc_id", "text"), fit(docs))
    return named.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "language.lang_pred", "language.score")
