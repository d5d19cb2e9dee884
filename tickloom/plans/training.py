"""MLlib training queries. A fitted ensemble has no SQL form: what it is fitted on and judged by has, and that is compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import features as FT
from tickloom.operators import modeling as M
from tickloom.operators.sequences import minmax_inverse
from tickloom.operators.series import attach
from tickloom.plans import sql as S
from tickloom.plans.registry import query, show
from tickloom.plans.sql import W, r
from tickloom.schemas import TARGET
from tickloom.session import written
from tickloom.sources import views

COLUMNS = FT.columns_of(FT.EDA)
LENGTH = 12
ROWS = f"WITH {S.TECHNICAL_CTES}, ok AS (SELECT symbol, date, {TARGET} AS y, row_number() {W} - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM feat WHERE {S.complete([*COLUMNS, TARGET])})"
SAMPLES = (
    f"{ROWS}, w AS (SELECT symbol, pos - {LENGTH - 1} AS sample, n - {LENGTH + 1} AS samples, lead(y) {W} AS y FROM ok QUALIFY pos >= {LENGTH - 1} AND pos < n - 2), "
    "s AS (SELECT *, sample < floor(samples * 0.8) AS train FROM w WHERE samples >= 50), "
    "m AS (SELECT symbol, avg(y) AS mean FROM s WHERE train GROUP BY symbol) "
    "SELECT symbol, CAST(count(CASE WHEN train THEN 1 END) AS BIGINT) AS train_samples, CAST(count(CASE WHEN NOT train THEN 1 END) AS BIGINT) AS test_samples, "
    f"{r('sqrt(avg(CASE WHEN NOT train THEN (y - mean) * (y - mean) END))', 6)} AS mean_rmse, true AS learned, true AS judged FROM s JOIN m USING (symbol) GROUP BY symbol"
)


def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table as training reads it: written once, since training goes over it several times."""
    return written(FT.features(views.bars(spark, sf), groups=FT.EDA), "features")


def trained(spark: SparkSession, sf: str, model_type: str, params: dict) -> DataFrame:
    """Per symbol: samples of both parts, the error of the training mean on the test part, whether the model's test error is a number
    of at most twice that, and whether its error on the training part is below that of the mean over all symbols."""
    model, store, metrics = M.train(feature_table(spark, sf), model_type, params, COLUMNS)
    known = minmax_inverse(store.rows, store.scaler, "label", TARGET, "y").select("symbol", "date", "role", "y")
    means = known.filter("role = 'train'").groupBy("symbol").agg(F.avg("y").alias("mean"))
    off = F.when(F.col("role") == "test", (F.col("y") - F.col("mean")) * (F.col("y") - F.col("mean")))
    counts = attach(known, means).groupBy("symbol").agg(
        F.count_if(F.col("role") == "train").alias("train_samples"), F.count_if(F.col("role") == "test").alias("test_samples"), F.sqrt(F.avg(off)).alias("mean_rmse")
    )
    fitted = model.transform(store.vectors("train"))
    spread = fitted.agg((F.avg(F.pow(F.col("label") - F.col("prediction"), 2)) < F.var_pop("label")).alias("learned"))
    out = counts.join(metrics.select("symbol", "rmse"), "symbol").withColumn("judged", F.col("rmse") <= 2 * F.col("mean_rmse"))
    return show(out.withColumn("learned", spread.scalar()), "symbol", "train_samples", "test_samples", "learned", "judged", mean_rmse=6)


@query("train_gbt", SAMPLES)
def train_gbt(spark: SparkSession, sf: str) -> DataFrame:
    return trained(spark, sf, "gbt", {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.1, "sequence_length": LENGTH})


@query("train_rf", SAMPLES)
def train_rf(spark: SparkSession, sf: str) -> DataFrame:
    return trained(spark, sf, "random_forest", {"n_estimators": 20, "max_depth": 5, "sequence_length": LENGTH})


TRIALS = [
    {"model_type": "gbt", "n_estimators": "3", "max_depth": "3", "learning_rate": "0.1"},
    {"model_type": "random_forest", "n_estimators": "10", "max_depth": "3"},
]
SPLITS, HOLDOUT = 5, 90


def searched(spark: SparkSession, sf: str) -> M.Search:
    return M.cv_search(feature_table(spark, sf), TRIALS, SPLITS, COLUMNS, holdout=HOLDOUT)


@query(
    "cv_search",
    f"{ROWS}, i AS (SELECT *, greatest(n - {HOLDOUT}, 0) AS inside FROM ok), f AS (SELECT CAST(k AS INTEGER) AS split, pos, inside // {SPLITS + 1} AS size, "
    f"inside - ({SPLITS + 1} - k) * (inside // {SPLITS + 1}) AS start FROM i, generate_series(1, {SPLITS}) g(k)) "
    "SELECT CAST(t AS BIGINT) AS trial_id, split, CAST(count(CASE WHEN pos < start THEN 1 END) AS BIGINT) AS train_rows, "
    "CAST(count(CASE WHEN pos >= start AND pos < start + size THEN 1 END) AS BIGINT) AS test_rows, true AS scored "
    f"FROM f, generate_series(1, {len(TRIALS)}) h(t) GROUP BY t, split",
)
def cv_search(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each fold, and that every trial has an error on it."""
    found = searched(spark, sf)
    folds = None
    for split in range(1, SPLITS + 1):
        before, test = M.fold(split, SPLITS)
        counts = found.rows.agg(F.count_if(before).alias("train_rows"), F.count_if(test).alias("test_rows")).withColumn("split", F.lit(split))
        folds = counts if folds is None else folds.unionByName(counts)
    return found.scores.join(folds, "split").select("trial_id", "split", "train_rows", "test_rows", (F.col("score") <= 0).alias("scored"))


@query(
    "cv_holdout",
    f"{ROWS} SELECT symbol, count(*) AS n, true AS judged FROM ok WHERE pos >= greatest(n - {HOLDOUT}, 0) GROUP BY symbol",
)
def cv_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """The best setting, fitted anew, on the rows held out: how many they are, and that error and hit rate are in range."""
    holdout = searched(spark, sf).holdout
    judged = F.col("hit_rate").between(0, 100) & (F.col("rmse") >= F.col("mae")) & (F.col("mae") > 0)
    return holdout.select("symbol", "n", judged.alias("judged"))
