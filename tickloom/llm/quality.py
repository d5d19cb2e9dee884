"""Quality rules as a short-circuit cascade.

A rule says for a text whether it fails. The cascade first runs every rule on a bounded sample, measures its time and the
share it rejects, and orders the rules by rejections per second; a text is then judged by the first rule that rejects it
and never reaches the later, costlier ones. Order changes the time only: a text is kept if no rule rejects it.

Only DataFrame expressions are used. Edge cases: a null text has no words; empty texts fail the word count. Words,
lines and windows are taken from whole texts, and the work is linear in the text (sorting apart) for texts of any length.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import SPACE, documents, text_of, with_columns_kept

WINDOW = 8
#: The characters that count as symbols, and white space.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, BLANKS, ""))


def n_symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def worded_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)


def n_dup_lines(text: Column) -> Column:
    return bound(worded_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def n_repeat_words(tokens: Column, size: int = WINDOW) -> Column:
    """Words inside a window of ``size`` words that occurs at least twice in the text, the first time included.

    Windows are compared by a 64-bit hash of their words. Texts without a repeated window, nearly all, stop after one
    hash set; in the others windows are sorted by hash, and the covered words are counted from the sorted starts.
    """
    places = F.sequence(F.lit(1), F.size(tokens) - size + 1)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(tokens, i - 1 + k) for k in range(size)]))

    def covered(found: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = bound(
            ordered,
            lambda o: F.sort_array(
                F.transform(
                    F.filter(
                        o, lambda x, j: ((j > 0) & (F.get(o, F.greatest(j - 1, F.lit(0)))["h"] == x["h"])) | F.coalesce(F.get(o, j + 1)["h"] == x["h"], F.lit(False))
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        spans = bound(starts, lambda s: F.transform(s, lambda p, j: F.coalesce(F.least(F.get(s, j + 1) - p, F.lit(size)), F.lit(size))))
        return F.aggregate(spans, F.lit(0), lambda a, b: a + b)

    counted = bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(F.size(tokens) > size, counted).otherwise(0)


@dataclass(frozen=True)
class Rule:
    """A text fails the rule where ``fails`` of (text, words) is true."""

    name: str
    fails: object


def base_failed(n_words: Column, repeated: Column) -> Column:
    return (n_words < 20) | (100 * repeated > 30 * n_words)


def _copied_lines(text: Column, tokens: Column) -> Column:
    return bound(worded_lines(text), lambda lines: 10 * (F.size(lines) - F.size(F.array_distinct(lines))) > 3 * F.size(lines))


#: Each says what a clean text never is: too short, made of symbols, of copied lines or windows, or of odd words.
RULES = (
    Rule("short", lambda text, tokens: F.size(tokens) < 20),
    Rule("repeated_words", lambda text, tokens: 100 * n_repeat_words(tokens) > 30 * F.size(tokens)),
    Rule("symbols", lambda text, tokens: 10 * n_symbols(text) > F.size(tokens)),
    Rule("copied_lines", _copied_lines),
    Rule("odd_words", lambda text, tokens: (word_chars(text) < 2 * F.size(tokens)) | (word_chars(text) > 15 * F.size(tokens))),
    Rule("shouting", lambda text, tokens: F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")) * 2 < F.length(text)),
)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = 400) -> list[Measured]:
    """Seconds and share rejected of each rule on at most ``sample_rows`` texts.

    The sample is taken once, from the first partitions that suffice, and is a table of its own: no rule scans or shuffles the documents.
    """
    spark = docs.sparkSession
    taken = docs.select(text_of().alias("text")).take(sample_rows)
    sample = spark.createDataFrame(taken, "text string").coalesce(1).select("text", words(F.col("text")).alias("tokens"))

    def timed(failing: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share = sample.agg(F.avg(F.when(F.size("tokens") > -1, failing).cast("int"))).first()[0]
        return time.perf_counter() - began, share or 0.0

    timed(F.lit(False))  # compiles what all runs share
    idle, _ = timed(F.lit(False))
    return [Measured(rule, max(seconds - idle, 1e-3), share) for rule in rules for seconds, share in [timed(rule.fails(F.col("text"), F.col("tokens")))]]


def ordered(measured: list[Measured]) -> list[Rule]:
    """Most rejections per second first; the given order decides between equals."""
    return [m.rule for m in sorted(measured, key=lambda m: -m.rejected / m.seconds)]


def verdict(rules: list[Rule], text: Column, tokens: Column) -> Column:
    """True if no rule rejects; a rule is looked at only if the ones before it pass."""
    kept = F.lit(True)
    for rule in reversed(rules):
        kept = F.when(rule.fails(text, tokens), False).otherwise(kept)
    return kept


def kept_only(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with their own columns."""
    order = ordered(measure(docs, rules))
    # the words are bound inside the condition: as a column they would be cut again for each use once it is pushed down
    passes = bound(words(F.col("text")), lambda tokens: verdict(order, F.col("text"), tokens))
    return with_columns_kept(docs).where(passes).select("row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    extra = tuple(r for r in RULES if r.name not in ("short", "repeated_words"))  # these two are the base, computed for all
    order = ordered(measure(docs, extra))
    text = text_of()

    def judged(tokens: Column, repeated: Column) -> Column:
        failed = base_failed(F.size(tokens), repeated)
        counts = {"n_words": F.size(tokens), "word_chars": word_chars(text), "n_symbols": n_symbols(text), "n_dup_lines": n_dup_lines(text), "n_repeat_words": repeated}
        kept = F.when(failed, False).otherwise(verdict(order, text, tokens))
        return F.struct(*[c.cast("long").alias(name) for name, c in counts.items()], failed.alias("base_failed"), kept.alias("kept"))

    # one column, so that a filter on it that is pushed down does not cut the words again for each use
    result = bound(words(text), lambda tokens: bound(n_repeat_words(tokens), lambda repeated: judged(tokens, repeated)))
    return docs.select("doc_id", result.alias("result")).select("doc_id", "result.*")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LEADS = " || ' ' || ".join(f"lead(word, {k}) OVER o" for k in range(1, WINDOW))
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
                  [l FOR l IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines FROM documents),
c AS (SELECT *, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals FROM d),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM c WHERE n_words > {WINDOW}),
g AS (SELECT doc_id, i, word || ' ' || {_LEADS} AS gram FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g WHERE gram IS NOT NULL),
s AS (SELECT doc_id, least(lead(i, 1, i + {WINDOW}) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW}) AS gain FROM k WHERE n > 1),
r AS (SELECT doc_id, sum(gain) AS n_repeat_words FROM s GROUP BY doc_id),
b AS (SELECT c.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words,
             n_words < 20 OR 100 * coalesce(r.n_repeat_words, 0) > 30 * n_words AS base_failed FROM c LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * len(lines)
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * (length(text) - capitals) < length(text)) AS kept
FROM b
"""
