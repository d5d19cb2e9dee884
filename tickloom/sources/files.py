"""Tables as files: explicit schemas on read, absent paths read as empty tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.scalar import null_if_nan
from tickloom.operators.columns import drop_stray_index

READ_OPTIONS = {
    "csv": {"header": "true", "enforceSchema": "false"},
    "json": {},
    "parquet": {},
    "orc": {},
}
WRITE_OPTIONS = {"csv": {"header": "true"}, "json": {"ignoreNullFields": "false"}}


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", **options: str) -> DataFrame:
    """Read a table with its schema; a path that does not exist gives an empty table.  NaN becomes NULL."""
    reader = spark.read.schema(schema).options(**{**READ_OPTIONS.get(fmt, {}), **options})
    try:
        df = reader.format(fmt).load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return spark.createDataFrame([], schema)
    numbers = [f.name for f in schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: null_if_nan(c) for c in numbers}) if numbers else df


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    writer = df.write.format(fmt).mode(mode).options(**WRITE_OPTIONS.get(fmt, {}))
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def read_json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Pretty-printed JSON files, one object per file."""
    return read_table(spark, path, schema, "json", multiLine="true")


def read_csv_loose(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose columns are only known from its header, as strings, left-over index columns dropped."""
    return drop_stray_index(spark.read.option("header", "true").csv(path))


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast the columns of ``schema`` that the table has; the others become NULL."""
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def scan_bars(
    spark: SparkSession, path: str, schema: T.StructType, since=None, symbol: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Landed bars from a date on; the filters reach the Parquet scan."""
    df = read_table(spark, path, schema, fmt)
    if since is not None:
        df = df.filter(F.col("date") >= F.lit(since))
    return df if symbol is None else df.filter(F.col("symbol") == symbol)
