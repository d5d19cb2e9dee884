"""Bounded runs of the streaming jobs; each must equal the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.scalar import utc_instant
from tickloom.operators.upsert import latest
from tickloom.plans import sql as S
from tickloom.plans.monitoring import RAISED, VERDICT, sides
from tickloom.plans.registry import query, show
from tickloom.plans.sql import r
from tickloom.plans.tables import HALVES, TS, UPSERTED, event_logs, halves
from tickloom.schemas import BARS as BARS_SCHEMA
from tickloom.session import scratch_path
from tickloom.sources import views
from tickloom.sources.logs import build_log, flatten_features
from tickloom.streaming import jobs


@query(
    "stream_daily_bars",
    "SELECT event_type AS symbol, CAST(ts AS DATE) AS date, min_by(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, "
    "max_by(value, (ts, event_id)) AS close, CAST(sum(event_id % 7 + 1) AS BIGINT) AS volume FROM events GROUP BY ALL",
)
def stream_daily_bars(spark: SparkSession, sf: str) -> DataFrame:
    schema = views.table(spark, sf, "events").schema
    events = jobs.file_stream(spark, sf, schema, glob="events.parquet")
    ticks = events.select(
        F.col("event_type").alias("symbol"),
        utc_instant("ts").alias("ts"),
        F.col("value").alias("price"),
        F.col("event_id").alias("tie"),
        (F.col("event_id") % 7 + 1).alias("quantity"),
    )
    path = scratch_path(spark, "stream-bars")
    jobs.run(jobs.daily_bars(ticks), jobs.versioned_sink(f"{path}/table"), f"{path}/checkpoint", mode="update")
    return jobs.read_versions(spark, f"{path}/table", BARS_SCHEMA, ["symbol", "date"]).select(*BARS_SCHEMA.names)


@query(
    "stream_history_upsert",
    f"WITH {S.BARS}, {HALVES}, {UPSERTED} SELECT symbol, date, open, high, low, {r('close', 4)} AS close, volume FROM up",
)
def stream_history_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Two deliveries of bars, the second corrects a month of the first; both are there before the one run of the stream."""
    path = scratch_path(spark, "stream-upsert")
    for part in halves(spark, sf):
        part.write.mode("append").parquet(f"{path}/inbox")
    stream = jobs.delivered(jobs.file_stream(spark, f"{path}/inbox", BARS_SCHEMA))
    jobs.upsert_history(stream, f"{path}/table", f"{path}/checkpoint")
    out = jobs.read_versions(spark, f"{path}/table", BARS_SCHEMA, ["symbol", "date"])
    return show(out, "symbol", "date", "open", "high", "low", "volume", close=4)


@query("stream_log_ingest", f"WITH {S.LOGS} SELECT symbol, {TS} AS timestamp, value, k FROM logs WHERE k % 10 <> 0")
def stream_log_ingest(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "stream-logs")
    event_logs(spark, sf).repartition(4).write.json(f"{path}/inbox")
    jobs.ingest_logs(spark, f"{path}/inbox", f"{path}/table", f"{path}/checkpoint", files_per_trigger=2)
    return flatten_features(spark.read.parquet(f"{path}/table"), ["value", "k"], keep=("symbol", "timestamp"))


NEWEST = (
    "WHERE side = 'reference' OR event_id IN (SELECT event_id FROM (SELECT event_id, row_number() OVER "
    "(PARTITION BY symbol ORDER BY ts + to_microseconds(event_id) DESC) AS n FROM logs WHERE side = 'current') WHERE n <= 100)"
)


@query(
    "stream_drift_check",
    VERDICT.replace("AS value, k FROM logs)", f"AS value, k FROM logs {NEWEST})", 1)
    + f" SELECT symbol, features, {r('drift_share', 6)} AS drift_share, drift_share >= 0.5 AS dataset_drift FROM verdict",
)
def stream_drift_check(spark: SparkSession, sf: str) -> DataFrame:
    """Logs arrive in several batches; the last verdict of a symbol is that on its newest 100 logs."""
    path = scratch_path(spark, "stream-drift")
    reference, _ = sides(spark, sf)
    factor = F.when(F.col("symbol").isin(RAISED), 1.5).otherwise(1.0)
    current = views.feature_logs(spark, sf).filter(F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz"))
    stamped = current.withColumns(
        {
            "value": F.col("value") * factor,
            "ts": F.timestamp_micros(F.unix_micros(utc_instant("ts")) + F.col("event_id")),
            "prediction_output": F.struct(F.lit(None).cast("double").alias("current_price")),
        }
    )
    build_log(stamped, ["value", "k"]).repartition(8).write.json(f"{path}/inbox")
    jobs.drift_checks(jobs.log_stream(spark, f"{path}/inbox", 2), reference, ["value", "k"], path, f"{path}/checkpoint")
    out = latest(spark.read.parquet(f"{path}/verdicts"), ["symbol"], jobs.BATCH)
    return show(out, "symbol", "features", "dataset_drift", drift_share=6)
