"""A corpus pipeline: filter, deduplicate, redact and pack ``documents``.

``STAGES`` lists the stages in order. Each is called with (spark, docs, sf_dir), is written as Parquet and reread as the
``docs`` of the next one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import stages
from tickloom.session import written

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.toxicity),
    ("quality", stages.quality),
    ("near_duplicates", stages.near_duplicates),
    ("secrets", stages.secrets),
    ("packing", stages.packing),
]

#: Models take part in three stages, which SQL cannot express; the tests compare with a plain version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the result of every stage but the last is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
