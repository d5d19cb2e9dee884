"""Results that become visible as a whole: each attempt writes a folder of its own, one last write names it.

``base/commits`` holds one small record per commit: what was committed (``name``) and the folder (``version``). Nothing under
``base`` is ever overwritten, so a job that stops between its writes leaves a folder that no record names, and a job that runs
again commits a newer version of the same name; readers follow the newest record of a name. Versions sort by the time they began, by the driver's clock.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources.files import read_table

COMMIT = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "version")])
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


def checked(name: str) -> str:
    """A name that can be part of a path."""
    if not NAME.fullmatch(name):
        raise ValueError(f"{name!r} cannot name a folder")
    return name


def begin() -> str:
    """A version of one's own, larger than those begun before."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def folder(base: str, name: str, version: str) -> str:
    return f"{base}/data/name={checked(name)}/version={version}"


def commit(spark: SparkSession, base: str, name: str, version: str) -> None:
    """Make a version visible. Spark publishes the one file of the record by a rename."""
    record = spark.createDataFrame([(checked(name), version)], COMMIT)
    record.coalesce(1).write.mode("append").json(f"{base}/commits")


def commits(spark: SparkSession, base: str) -> DataFrame:
    """``name, version``: the newest version of each name."""
    return read_table(spark, f"{base}/commits", COMMIT, "json").groupBy("name").agg(F.max("version").alias("version"))


def current(spark: SparkSession, base: str, name: str) -> str | None:
    """The newest version of one name, None before the first."""
    row = commits(spark, base).where(F.col("name") == name).first()
    return row["version"] if row else None


def read_committed(spark: SparkSession, base: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Rows of the newest version of every name, with ``name``; folders that no commit names are not opened."""
    full = T.StructType([*schema.fields, *COMMIT.fields])
    rows = read_table(spark, f"{base}/data", full, fmt)
    return rows.join(commits(spark, base), ["name", "version"], "left_semi").drop("version")
