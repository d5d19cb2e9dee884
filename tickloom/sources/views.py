"""Market-shaped DataFrames over the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.scalar import drop_zone
from tickloom.operators.bars import bars_from_ticks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (symbol, date, open, high, low, close, volume), unique per symbol and day."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        drop_zone("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderkey") % 997 + 1).alias("quantity"),
    )
    return bars_from_ticks(orders, tie="id")


def macro_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro closes (date, series, close) of three series."""
    flag = F.col("l_returnflag")
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            drop_zone("l_shipdate").alias("date"),
            F.when(flag == "A", "SP500").when(flag == "N", "VIX").otherwise("EURUSD").alias("series"),
            "l_extendedprice",
        )
        .groupBy("date", "series")
        .agg(F.avg("l_extendedprice").alias("close"))
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored headlines (symbol, published, headline, scores)."""

    def score(label: str, value: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), value.alias("score"))

    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_orderpriority").alias("symbol"),
        (F.unix_date(drop_zone("l_shipdate")).cast("bigint") * 86400 + 43200).alias("published"),
        F.when(F.col("l_quantity") > 2, F.concat(F.lit("order "), F.col("l_orderkey"))).alias("headline"),
        F.array(
            score("positive", F.col("l_discount") * 10), score("Negative", F.col("l_tax") * 10), score("neutral", F.lit(0.1))
        ).alias("scores"),
    )


def feature_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged feature values (symbol, ts, event_id, value, k)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        "event_id",
        "value",
        F.from_json("props", "k INT")["k"].cast("double").alias("k"),
    )


def log_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reference (first half of the month) and current (second half) feature values."""
    logs = feature_logs(spark, sf_dir)
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    columns = ["symbol", "value", "k"]
    return logs.filter(F.col("ts") < cut).select(columns), logs.filter(F.col("ts") >= cut).select(columns)


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training runs (symbol, trial_id, rmse)."""
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("symbol"), F.col("p_partkey").alias("trial_id"), F.col("p_retailprice").alias("rmse")
    )


def cv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validation scores (trial_id, split, score)."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("trial_id"), F.col("l_linenumber").alias("split"))
        .agg((-F.avg("l_discount")).alias("score"))
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actual and predicted values (symbol, y, p): line items against a fixed discount model."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("symbol"),
        (F.col("l_discount") - 0.05).alias("y"),
        (F.col("l_tax") - 0.04).alias("p"),
    )
