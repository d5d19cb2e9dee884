"""Prediction logs: one JSON record per prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalar import finite
from tickloom.operators.series import first_rows
from tickloom.schemas import PREDICTION_LOG
from tickloom.sources import versions
from tickloom.sources.files import read_table

LOG_LIMIT = 100
MODEL_VERSION = "champion"  # fixed value of stored records
KEY_FORMAT = "yyyy-MM-dd'T'HH-mm-ss-SSSSSS"  # fixed pattern of stored names
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"  # fixed pattern of stored records


def build_log(df: DataFrame, features: Sequence[str], ts: str = "ts", version: str = MODEL_VERSION) -> DataFrame:
    """Nested log records from rows with features and an output struct ``prediction_output``.

    Features are a map, so an empty feature list gives ``{}`` and later features need no schema change.
    """
    entries = [x for c in features for x in (F.lit(c), F.col(c).cast("double"))]
    block = F.create_map(*entries) if entries else F.map_from_arrays(F.array(), F.array())
    return df.select(
        "symbol",
        F.date_format(ts, TIME_FORMAT).alias("timestamp"),
        F.lit(version).alias("model_version"),
        block.cast(T.MapType(T.StringType(), T.DoubleType())).alias("features_input"),
        "prediction_output",
    )


def log_key(symbol: Column, ts: Column) -> Column:
    """Path of a log record."""
    return F.concat(F.lit("predictions/"), symbol, F.lit("/"), F.date_format(ts, KEY_FORMAT), F.lit(".json"))


def write_logs(logs: DataFrame, path: str) -> None:
    """Append records, one folder per symbol."""
    logs.withColumn("_folder", F.col("symbol")).write.partitionBy("_folder").mode("append").json(path)


def append_job(logs: DataFrame, path: str, job: str) -> None:
    """Add the records of a batch job. A job that runs again, whole or after it broke off, replaces its own records."""
    version = versions.begin()
    logs.write.json(versions.folder(path, job, version))
    versions.commit(logs.sparkSession, path, job, version)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Records of all jobs that ended, with ``job``."""
    return versions.read_committed(spark, path, PREDICTION_LOG, "json").withColumnRenamed("name", "job")


def read_logs(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """All records below ``path`` with the modification time of their file."""
    df = read_table(spark, path, PREDICTION_LOG, "json", recursiveFileLookup="true", pathGlobFilter="*.json", **options)
    try:
        return df.withColumn("mtime", F.col("_metadata.file_modification_time"))
    except AnalysisException:  # the empty table of an absent path has no files
        return df.withColumn("mtime", F.lit(None).cast("timestamp"))


def newest(logs: DataFrame, order: Sequence[Column | str], n: int = LOG_LIMIT) -> DataFrame:
    """The newest ``n`` records with features per symbol."""
    kept = logs.filter(F.col("features_input").isNotNull()) if "features_input" in logs.columns else logs
    return first_rows(kept, "symbol", order, n)


def flatten_features(logs: DataFrame, features: Sequence[str], keep: Sequence[str] = ("symbol",)) -> DataFrame:
    """One column per feature; a feature that a record lacks, or that is not a number, is NULL."""
    return logs.filter(F.col("features_input").isNotNull()).select(
        *keep, *[finite(F.col("features_input")[c]).alias(c) for c in features]
    )
