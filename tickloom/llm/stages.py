"""The stages of ``corpus_pipeline``. All but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import ngram_join as near
from tickloom.llm import packing as windows
from tickloom.llm import quality as rules
from tickloom.llm import secrets as scan
from tickloom.llm import toxicity as tox
from tickloom.llm.common import with_columns_kept
from tickloom.llm.tokens import byte_encoder
from tickloom.session import written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely clean than toxic."""
    model = tox.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return tox.with_score(with_columns_kept(docs), model).where(F.col("score") < 0.5).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return rules.kept_only(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the one with the smallest id, then text; rows without an id come last.

    Rows are judged each by its own text, whatever ids they repeat; those without words are copies of nothing and stay.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row")), "near-rows")
    doc_id, text = F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.text").alias("text")
    roots = written(near.rooted(rows.select("key", doc_id, text)).where("root is not null").select("key", "root"), "near-roots")
    several = roots.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    group = written(roots.join(several, "root"), "near-groups")
    ranked = group.join(rows.hint("merge"), "key").select("root", F.struct(doc_id.isNull().alias("last"), doc_id, text, "key").alias("rank"))
    first = ranked.groupBy("root").agg(F.min("rank").alias("rank")).select("rank.key")
    copies = group.select("key").join(first, "key", "left_anti")
    return rows.join(copies.hint("merge"), "key", "left_anti").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced in the text."""
    network = scan.fit(docs)
    return docs.withColumn("text", scan.redacted(network, F.col("text")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids (little-endian 32-bit integers), window and offset."""
    return windows.packed(written(windows.with_pieces(docs, byte_encoder(), keep_ids=True), "pieces"))
