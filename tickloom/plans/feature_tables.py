"""Feature table queries."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import bars as B
from tickloom.operators import features as FT
from tickloom.operators.columns import null_counts
from tickloom.operators.news import daily_sentiment, scored
from tickloom.operators.series import attach
from tickloom.operators.transformer import FeatureTable
from tickloom.plans import sql as S
from tickloom.plans.registry import query, show
from tickloom.schemas import FEATURES, TARGET
from tickloom.session import written
from tickloom.sources import views

# Digits per column: prices keep fewer, so that the last bits of a double never decide.
DIGITS = {c: 6 for c in [*FEATURES, TARGET]}
DIGITS.update({"MACD_Line": 3, "MACD_Signal": 3, "MACD_Histogram": 3, "ATR_14": 3, "RSI_14": 5, "OBV_ROC_5": 4})


def digits(columns: list[str]) -> dict[str, int]:
    return {c: DIGITS[c] for c in columns}


def sql_columns(columns: list[str]) -> str:
    return ", ".join(f"{S.r(c, DIGITS[c])} AS {c}" for c in columns)


def inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    returns = B.macro_returns(views.macro_long(spark, sf))
    sentiment = daily_sentiment(scored(views.news(spark, sf)))
    return views.bars(spark, sf), returns, sentiment


ALL = [*FEATURES, TARGET]
BASE_COLUMNS = FT.GROUPS["base"]
OSC_COLUMNS = [*BASE_COLUMNS, "RSI_14", "MACD_Histogram"]
EDA_COLUMNS = FT.columns_of(FT.EDA)


@query(
    "features_full",
    f"WITH {S.FEATURE_CTES} SELECT symbol, date, {sql_columns(ALL)} FROM feat WHERE {S.complete(ALL)}",
)
def features_full(spark: SparkSession, sf: str) -> DataFrame:
    return show(FT.features(*inputs(spark, sf)), "symbol", "date", **digits(ALL))


WITH_COUNT = "symbol, date, count(*) OVER (PARTITION BY symbol) AS n, count(Target_Log_Return) OVER (PARTITION BY symbol) AS targets"


@query(
    "features_training_mode",
    f"WITH {S.FEATURE_CTES} SELECT {WITH_COUNT}, {sql_columns(ALL)} FROM feat WHERE {S.complete(ALL)}",
)
def features_training_mode(spark: SparkSession, sf: str) -> DataFrame:
    return _counted(FT.features(*inputs(spark, sf), training=True))


@query(
    "features_inference_mode",
    f"WITH {S.FEATURE_CTES} SELECT {WITH_COUNT}, {sql_columns(ALL)} FROM feat WHERE {S.complete(FEATURES)}",
)
def features_inference_mode(spark: SparkSession, sf: str) -> DataFrame:
    return _counted(FT.features(*inputs(spark, sf), training=False))


def _counted(df: DataFrame) -> DataFrame:
    """The rows with how many rows and targets their symbol has."""
    df = written(df, "features")
    sizes = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count(TARGET).alias("targets"))
    return show(attach(df, sizes), "symbol", "date", "n", "targets", **digits(ALL))


@query(
    "transformer_features",
    f"WITH {S.TECHNICAL_CTES} SELECT symbol, date, 0.0::DOUBLE AS VIX_Return, 0.0::DOUBLE AS Sentiment_Score, {sql_columns([*EDA_COLUMNS, TARGET])} FROM feat WHERE {S.complete(EDA_COLUMNS)}",
)
def transformer_features(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table as a stage of an ML pipeline, set to inference and without macro and sentiment tables, which then are 0."""
    stage = FeatureTable(training=False)
    out = Pipeline(stages=[stage]).fit(views.bars(spark, sf)).transform(views.bars(spark, sf))
    return show(out, "symbol", "date", "VIX_Return", "Sentiment_Score", **digits([*EDA_COLUMNS, TARGET]))


@query(
    "features_fallback_zero",
    f"WITH {S.BARS}, young AS (SELECT CASE WHEN symbol = '1-URGENT' "
    "THEN concat(symbol, '/', year(date), '/', month(date)) ELSE symbol END AS symbol, date, open, high, low, close, volume "
    f"FROM bars), {S.features('young', join=False)}, marked AS (SELECT *, {S.complete(EDA_COLUMNS)} AS ok FROM feat), "
    "anyok AS (SELECT symbol, max(ok) AS any_ok FROM marked GROUP BY symbol) "
    + "SELECT symbol, date, "
    + ", ".join(f"{S.r(f'coalesce({c}, 0)', DIGITS[c])} AS {c}" for c in EDA_COLUMNS)
    + " FROM marked JOIN anyok USING (symbol) WHERE ok OR NOT any_ok",
)
def features_fallback_zero(spark: SparkSession, sf: str) -> DataFrame:
    # One symbol becomes a young symbol per month, too short for any complete row.
    month = F.concat_ws("/", "symbol", F.year("date"), F.month("date"))
    young = views.bars(spark, sf).withColumn("symbol", F.when(F.col("symbol") == "1-URGENT", month).otherwise(F.col("symbol")))
    return show(FT.features(young, training=False, groups=FT.EDA), "symbol", "date", **digits(EDA_COLUMNS))


@query(
    "features_base",
    f"WITH {S.TECHNICAL_CTES} SELECT symbol, date, close, volume, OBV, {sql_columns([*BASE_COLUMNS, TARGET])} "
    f"FROM feat WHERE {S.complete([*BASE_COLUMNS, TARGET])}",
)
def features_base(spark: SparkSession, sf: str) -> DataFrame:
    out = FT.features(views.bars(spark, sf), groups=FT.BASE)
    return show(out, "symbol", "date", "close", "volume", "OBV", **digits([*BASE_COLUMNS, TARGET]))


@query(
    "features_rsi_macd",
    f"WITH {S.TECHNICAL_CTES} SELECT symbol, date, close, volume, OBV, {sql_columns([*OSC_COLUMNS, TARGET])} "
    f"FROM feat WHERE {S.complete([*OSC_COLUMNS, TARGET])}",
)
def features_rsi_macd(spark: SparkSession, sf: str) -> DataFrame:
    out = FT.features(views.bars(spark, sf), groups=FT.OSCILLATORS)
    return show(out, "symbol", "date", "close", "volume", "OBV", **digits([*OSC_COLUMNS, TARGET]))


@query(
    "features_eda",
    f"WITH {S.TECHNICAL_CTES} SELECT symbol, date, {sql_columns([*EDA_COLUMNS, TARGET])} "
    f"FROM feat WHERE {S.complete([*EDA_COLUMNS, TARGET])}",
)
def features_eda(spark: SparkSession, sf: str) -> DataFrame:
    return show(FT.eda_features(views.bars(spark, sf)), "symbol", "date", **digits([*EDA_COLUMNS, TARGET]))


@query(
    "dropna_features",
    f"WITH {S.TECHNICAL_CTES} SELECT symbol, date, {sql_columns(BASE_COLUMNS)} FROM feat WHERE {S.complete(BASE_COLUMNS)}",
)
def dropna_features(spark: SparkSession, sf: str) -> DataFrame:
    raw = FT.raw_features(views.bars(spark, sf), groups=("base",))
    return show(raw.na.drop(subset=BASE_COLUMNS), "symbol", "date", **digits(BASE_COLUMNS))


@query(
    "null_counts",
    f"WITH {S.FEATURE_CTES}, counts AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM feat" for c in FEATURES)
    + ") SELECT * FROM counts WHERE nulls > 0",
)
def null_counts_query(spark: SparkSession, sf: str) -> DataFrame:
    return null_counts(FT.raw_features(*inputs(spark, sf)), FEATURES)


@query(
    "direction_target",
    f"WITH {S.BARS}, a AS (SELECT symbol, date, ln(close / lag(close) {S.W}) AS lr FROM bars), "
    f"b AS (SELECT symbol, date, lead(lr) {S.W} AS target FROM a) "
    "SELECT symbol, date, CAST(target > 0 AS INTEGER) AS direction FROM b WHERE target IS NOT NULL",
)
def direction_target(spark: SparkSession, sf: str) -> DataFrame:
    raw = FT.raw_features(views.bars(spark, sf), groups=("base",))
    return raw.filter(F.col(TARGET).isNotNull()).select(
        "symbol", "date", (F.col(TARGET) > 0).cast("int").alias("direction")
    )
