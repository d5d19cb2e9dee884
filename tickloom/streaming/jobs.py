"""Structured Streaming: bars from ticks, history upsert, log ingest, periodic drift checks.

Each job runs on files with ``availableNow`` and ends when the input is used up; a longer trigger makes it run on.
Sinks write one folder per micro-batch and overwrite it on a retry, so a batch that runs again leaves no duplicates.
Readers pick the newest version per key.  A batch costs its own rows and bounded state, not the table; only every
so many batches the upsert folds the table into a new base, which bounds what readers open.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions.scalar import utc_date
from tickloom.operators.drift import drift, verdict
from tickloom.operators.upsert import latest
from tickloom.schemas import PREDICTION_LOG
from tickloom.sources import versions
from tickloom.sources.files import read_table
from tickloom.sources.logs import LOG_LIMIT, flatten_features, newest

BATCH = "batch_id"
DELIVERED = "delivered"
FOLD_EVERY = 32


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int | None = None, glob: str | None = None
) -> DataFrame:
    """A directory as a stream of its files."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.option("recursiveFileLookup", "true").load(path)


def versioned_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer: one folder per batch, overwritten if the batch runs again."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return write


BASE = "base"  # what a compacted version is committed as


def bases(path: str) -> str:
    return f"{path}-bases"


def read_versions(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The newest row per key: of the last compacted version and the batches after it; earlier batches are not opened."""
    return latest(_since_base(spark, path, schema), keys, BATCH)


def _since_base(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    batches = spark.read.schema(full).parquet(path)
    base = versions.current(spark, bases(path), BASE)
    if base is None:
        return batches
    folded = spark.read.schema(full).parquet(versions.folder(bases(path), BASE, base))
    return folded.unionByName(batches.filter(F.col(BATCH) > int(base.split("-")[0])))


def fold(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], batch_id: int) -> None:
    """Compact what is there up to batch ``batch_id`` into a new base; readers see it with the one write that commits it."""
    version = f"{batch_id:020d}-{uuid.uuid4().hex}"
    rows = latest(_since_base(spark, path, schema), keys, BATCH).withColumn(BATCH, F.lit(batch_id).cast("bigint"))
    rows.write.parquet(versions.folder(bases(path), BASE, version))
    versions.commit(spark, bases(path), BASE, version)


def compact(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], to: str) -> None:
    """Fold all versions into one at a new path, as the base for a stream that goes on there; batches have numbers from 0 on."""
    read_versions(spark, path, schema, keys).write.parquet(f"{to}/{BATCH}=-1")


def run(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Start the stream on everything that is there and wait for its end."""
    query = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )
    query.awaitTermination()
    return query


def daily_bars(ticks: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Bars per symbol and UTC day from (symbol, ts TIMESTAMP, price, tie, quantity); state older than the lateness is dropped."""
    order = F.struct("ts", "tie")
    return (
        ticks.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 day").alias("_day"), "symbol")
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("quantity").alias("volume"),
        )
        .select("symbol", utc_date("_day.start").alias("date"), "open", "high", "low", "close", "volume")
    )


def delivered(stream: DataFrame) -> DataFrame:
    """A stream of files with the time at which the file of each row was delivered."""
    return stream.select("*", F.col("_metadata.file_modification_time").alias(DELIVERED))


def upsert_history(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str] = ("symbol", "date"), version: str = DELIVERED, every: int = FOLD_EVERY
) -> StreamingQuery:
    """Append each batch of bars as a version, one row per key; the newest batch wins on read.

    Within a batch the row with the highest ``version`` wins, so that it does not matter whether deliveries share a batch. After
    ``every`` batches the job folds them, so that a reader opens one base and fewer batches than that.
    """
    write = versioned_sink(path)
    schema = T.StructType([f for f in stream.schema.fields if f.name != version])

    def sink(df: DataFrame, batch_id: int) -> None:
        write(latest(df, list(keys), version), batch_id)
        if (batch_id + 1) % every == 0:
            fold(df.sparkSession, path, schema, keys, batch_id)

    return run(stream, sink, checkpoint)


def log_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    return file_stream(spark, path, PREDICTION_LOG, "json", files_per_trigger, "*.json")


def ingest_logs(spark: SparkSession, path: str, table: str, checkpoint: str, files_per_trigger: int | None = None) -> StreamingQuery:
    """Growing directory of JSON records to a Parquet table."""
    return run(log_stream(spark, path, files_per_trigger), versioned_sink(table), checkpoint)


def newest_state(df: DataFrame, path: str, batch_id: int, n: int) -> DataFrame:
    """The newest ``n`` logs of each symbol up to this batch: those up to the batch before, and this one's.

    Each batch writes its own state and reads one before it, so a batch costs its own rows and ``n`` a symbol, whatever came
    before. Batches run one after another, and one that runs again finds the state before it as it was.
    """
    spark = df.sparkSession
    before = read_table(spark, f"{path}/{BATCH}={batch_id - 1}", PREDICTION_LOG)
    both = before.unionByName(df.select(*PREDICTION_LOG.names))
    newest(both, [F.desc("timestamp")], n).write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
    return spark.read.schema(PREDICTION_LOG).parquet(f"{path}/{BATCH}={batch_id}")


def drift_checks(
    logs: DataFrame, reference: DataFrame, features: Sequence[str], path: str, checkpoint: str, n: int = LOG_LIMIT, **options
) -> StreamingQuery:
    """Each batch of logs is added to the table ``path/logs``; then the newest ``n`` logs per symbol in it are judged.

    However small the batches are, a symbol is judged as soon as the table has enough of its logs. Verdicts go to
    ``path/verdicts``, one version for each batch. The newest logs are kept as state, so the table is not read again.
    """
    add, write = versioned_sink(f"{path}/logs"), versioned_sink(f"{path}/verdicts")

    def sink(df: DataFrame, batch_id: int) -> None:
        add(df, batch_id)
        current = flatten_features(newest_state(df, f"{path}/newest", batch_id, n), features)
        write(verdict(drift(reference, current, features=list(features), **options)), batch_id)

    return run(logs, sink, checkpoint)
