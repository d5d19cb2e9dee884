"""Helpers that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: white space between words, as a Java and DuckDB character class.
SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold_of(doc_id: Column, folds: int) -> Column:
    """The fold of a document, crc32 of its id as text modulo ``folds``; 0 without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def with_columns_kept(docs: DataFrame) -> DataFrame:
    """Two columns: ``row`` holds every input column, whatever it is called; ``text`` is the text, null as empty."""
    return docs.select(F.struct("*").alias("row"), text_of().alias("text"))
