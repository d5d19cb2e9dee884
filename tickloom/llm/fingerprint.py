"""I-Match fingerprints.

Terms whose inverse document frequency lies in a band make up the lexicon: neither the commonest words nor rare ones and
slips. A text's distinct lexicon terms, sorted, are hashed once for each of several random subsets of the lexicon, so
that a changed word spoils the hashes of a few subsets only, and the share of equal hashes says how alike two texts are.
Some small subsets hold one lexicon term in 512, for long texts and large changes, most one in 128; the last is the whole lexicon,
so that every text with a term has a hash and different sets of terms have different ones.

Only DataFrame expressions are used. The lexicon's size has a bound whatever the corpus: a term in a share of at least
``LOW`` of all texts is one of at most ``1 / LOW`` times the mean number of distinct terms of a text. Frequencies count
distinct texts, so that copies push no term out of the band. Near copies can: a text none of whose terms is in the lexicon is hashed
over all its terms, as it would have no fingerprint else.

Edge cases: null is an empty text. A text without a term has the hash of the text as its fingerprint, so it is like its
exact copies only. The document that follows is the next in order of id, then a hash of the text; null ids come first, and
after the last document comes the first, which may be the document itself. An empty table has no fingerprints.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import documents, text_of
from tickloom.session import written

#: Document frequency band, as shares of all distinct texts.
LOW, HIGH = 0.001, 0.2
#: One in how many lexicon terms a small subset holds, and how many such subsets there are; subsets of one kind share no term.
SUBSETS = {512: 16, 128: 40}
SLOTS = 8192
#: Bits that tell which texts may occur twice or more; they only spare shuffles.
BITS = 1 << 22


def term_hashes(text: Column) -> Column:
    """Hashes of a text's distinct words."""
    split = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(split, lambda w: F.xxhash64(w)))


def may_be_in(keys: DataFrame):
    """A test for keys, true for all of ``keys`` and for few others: a literal bit map, at most ``BITS / 64`` numbers whatever the table."""
    bit = lambda key: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(key, F.lit(64)).cast("int"))
    word = lambda key: F.floor(F.pmod(key, F.lit(BITS)) / 64).cast("int")
    held = {r["word"]: r["bits"] for r in keys.groupBy(word(F.col("key")).alias("word")).agg(F.bit_or(bit(F.col("key"))).alias("bits")).collect()}
    table = F.from_json(F.lit(json.dumps([held.get(k, 0) for k in range(BITS // 64)])), "array<bigint>")
    return lambda key: F.get(table, word(key)).bitwiseAND(bit(key)) != 0


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> list[int]:
    """Hashes of the terms in the band, counted over all distinct texts.

    All rows are counted, combined before the shuffle; of a text that ``n`` rows have, each row is then taken back by ``1 - 1 / n``.
    Only texts that occur twice or more are looked at again, and of the others few are shuffled for it.
    """
    texts = docs.select(text_of().alias("text"), F.xxhash64(text_of()).alias("key"))
    copies = texts.groupBy("key").agg(F.count("*").alias("n"))
    total = copies.count()
    every = texts.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    copied = written(copies.where("n > 1"), "copied")
    again = texts.where(may_be_in(copied)(F.col("key"))).join(copied, "key").select(F.explode(term_hashes(F.col("text"))).alias("term"), (1 - 1 / F.col("n")).alias("more"))
    surplus = again.groupBy("term").agg(F.sum("more").alias("more"))
    counts = every.join(surplus, "term", "left").select("term", (F.col("n") - F.round(F.coalesce("more", F.lit(0.0)))).alias("n"))
    return sorted(r["term"] for r in counts.where((F.col("n") >= max(2.0, low * total)) & (F.col("n") <= high * total)).select("term").collect())


def in_lexicon(terms: list[int]):
    """A test for hashes: a literal table of slots with the few terms of each."""
    slots: list[list[int]] = [[] for _ in range(SLOTS)]
    for term in terms:
        slots[term % SLOTS].append(term)
    table = F.from_json(F.lit(json.dumps(slots)), "array<array<bigint>>")
    return lambda h: F.array_contains(F.get(table, F.pmod(h, F.lit(SLOTS)).cast("int")), h)


def hashes(text: Column, known) -> Column:
    """One hash for each lexicon subset; null for subsets without a term of the text."""

    def told_apart(terms: Column) -> Column:
        return F.transform(F.array(F.filter(terms, known)), lambda held: F.when(F.size(held) > 0, held).otherwise(terms))[0]

    terms = F.transform(F.array(F.sort_array(term_hashes(text))), told_apart)[0]

    def hashed(held: Column) -> Column:
        return F.transform(F.array(held), lambda t: F.when(F.size(t) > 0, F.xxhash64(t)))[0]

    def in_subset(held: Column, n: int, k: int) -> Column:
        return hashed(F.transform(F.filter(held, lambda x: x[f"in_{n}"] == k), lambda x: x["h"]))

    def of_subsets(terms: Column) -> Column:
        # a term's hash says which subset of each kind it is in, if any; what is in none is put aside first
        placed = F.transform(terms, lambda h: F.struct(h.alias("h"), *[F.pmod(F.xxhash64(h, F.lit(n)), F.lit(n)).alias(f"in_{n}") for n in SUBSETS]))
        some = F.filter(placed, lambda x: reduce(or_, [x[f"in_{n}"] < many for n, many in SUBSETS.items()]))
        small = lambda held: [in_subset(held, n, k) for n, many in SUBSETS.items() for k in range(many)]
        return F.transform(F.array(some), lambda held: F.array(*small(held), F.xxhash64(terms)))[0]

    subsets = F.transform(F.array(terms), lambda t: F.when(F.size(t) > 0, of_subsets(t)))[0]
    return F.coalesce(subsets, F.array(F.xxhash64(F.lit("text"), text)))


def as_string(found: Column) -> Column:
    """Sixteen hexadecimal digits a hash, a dash without one."""
    return F.array_join(F.transform(found, lambda h: F.coalesce(F.lpad(F.lower(F.hex(h)), 16, "0"), F.lit("-"))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among subsets that have a term of either text."""
    both = F.arrays_zip(a.alias("a"), b.alias("b"))
    held = F.filter(both, lambda x: x["a"].isNotNull() | x["b"].isNotNull())
    same = F.filter(both, lambda x: x["a"] == x["b"])
    return F.when((F.size(a) == F.size(b)) & (F.size(held) > 0), F.size(same) / F.size(held)).otherwise(0.0)


def with_bucket(docs: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``hash`` of the text and ``bucket``, a range of (id, hash); and each bucket with the one ``before`` it.

    Ranges are cut at approximate quantiles of the ids. An id that many rows share, or no id, is cut further by the hash. Buckets are
    numbered in order; those that have a row are known on the driver, at most ``buckets`` squared numbers and two ranges more.
    """
    shares = [k / buckets for k in range(1, buckets)]
    row = docs.agg(F.percentile_approx("doc_id", shares or [0.5], 10_000).alias("cuts"), F.count("*").alias("n"), F.count("doc_id").alias("known")).first()
    cuts = list(row["cuts"] or []) if shares else []
    hot = sorted({c for c in cuts if cuts.count(c) > 1})
    # a hot id is a range of its own: between the ids below and above it
    edges = sorted({*cuts, *hot, *[c - 1 for c in hot]})
    place = F.size(F.filter(F.lit(edges).cast("array<bigint>"), lambda c: c < F.col("doc_id"))) + 1 if edges else F.lit(1)
    place = F.when(F.col("doc_id").isNull(), 0).otherwise(place)
    part = F.floor((F.col("hash") / 2.0**64 + 0.5) * buckets).cast("long")
    shared = F.col("doc_id").isNull() | F.col("doc_id").isin(hot) if hot else F.col("doc_id").isNull()
    placed = docs.withColumn("hash", F.xxhash64("text"))
    placed = placed.withColumn("bucket", place.cast("long") * (buckets + 1) + F.when(shared, F.least(part, F.lit(buckets))).otherwise(0))
    held = sorted(r["bucket"] for r in placed.select("bucket").distinct().collect())
    before = docs.sparkSession.createDataFrame(list(zip(held, held[-1:] + held[:-1])), "bucket long, before long")
    return placed, before


def fingerprints(docs: DataFrame):
    """``doc_id, text, next_text, own, next``, hashes of each text and of the text that follows it; and the lexicon's test."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", text_of().alias("text"))
    known = in_lexicon(lexicon(docs))
    placed, before = with_bucket(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "hash", "text")
    rows = placed.withColumn("following", F.lead("text").over(order)).withColumn("last", F.col("following").isNull())
    # the first document of a range follows the last one of the range before; of the first range, the very last one
    first = placed.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "hash", "text")).alias("f"))
    first = first.join(before, "bucket").select(F.col("before").alias("bucket"), F.lit(True).alias("last"), F.col("f.text").alias("across"))
    rows = rows.join(first, ["bucket", "last"], "left").withColumn("next_text", F.coalesce("following", "across"))
    rows = rows.select("bucket", "doc_id", "hash", "text", "next_text", "last", hashes(F.col("text"), known).alias("own"))
    after = F.lead("own").over(order)
    return rows.withColumn("next", F.when(F.col("last"), hashes(F.col("next_text"), known)).otherwise(after)), known


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, known = fingerprints(documents(spark, sf_dir))
    n = F.length("text")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 2).cast("int")), F.substring(F.col("next_text"), F.lit(1), F.floor(n / 2).cast("int")))
    rows = rows.withColumn("edited", edited).withColumn("edited_own", hashes(F.col("edited"), known))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string(F.col("own")).alias("fingerprint"), as_string(F.col("edited_own")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_own")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
