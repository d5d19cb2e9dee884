"""Training on MLlib: distributed tree ensembles on flattened sequences, trials, cross-validation, champions.

One model serves all symbols (each scaled by its own range) and is judged per symbol, so the number of fits is the
number of trials and does not grow with the symbols.  ``only`` restricts training to one symbol's rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.columns import scrub
from tickloom.operators.recurrences import State, with_state
from tickloom.operators.selection import champion
from tickloom.operators.sequences import (
    enough_samples,
    flat,
    minmax_apply,
    minmax_fit,
    minmax_inverse,
    regression_metrics,
    sequences,
    split_fraction,
)
from tickloom.operators.series import attach
from tickloom.schemas import FEATURES, TARGET
from tickloom.session import written
from tickloom.sources import versions

SEED = 42
MAX_DEPTH = 30  # what MLlib trees allow
#: Settings that MLlib's trees know, by their names in a trial.
SETTINGS = {
    "max_depth": ("maxDepth", int),
    "subsample": ("subsamplingRate", float),
    "colsample_bytree": ("featureSubsetStrategy", lambda v: str(float(v))),  # the integer 1 would be one feature, not all
    "min_child_samples": ("minInstancesPerNode", int),
}
TREES = {"gbt": {"n_estimators": ("maxIter", int), "learning_rate": ("stepSize", float)}, "random_forest": {"n_estimators": ("numTrees", int)}}
#: What a trial has besides: its name, and settings that are not the model's.
OTHER = {"model_type", "symbol", "trial", "trial_id", "sequence_length"}


def estimator(model_type: str, params: Mapping[str, str | int | float]):
    """An MLlib regressor for a trial's settings; a depth of -1 means as deep as MLlib allows.

    Settings that the model does not have, and depths beyond that limit, are errors. A rate of learning is ignored by forests,
    as all trials carry one.
    """
    if model_type not in TREES:
        raise ValueError(f"unknown model {model_type}")
    known = SETTINGS | TREES[model_type]
    given = {k: v for k, v in params.items() if k not in OTHER and not (k == "learning_rate" and model_type == "random_forest")}
    if unknown := given.keys() - known.keys():
        raise ValueError(f"{model_type} has no setting {sorted(unknown)}")
    values = {"maxDepth": 5, **{known[k][0]: known[k][1](v) for k, v in given.items()}}
    if values["maxDepth"] > MAX_DEPTH:
        raise ValueError(f"a depth of {values['maxDepth']} is more than MLlib's {MAX_DEPTH}")
    if values["maxDepth"] < 0:
        values["maxDepth"] = MAX_DEPTH
    common = {"featuresCol": "vector", "labelCol": "label", "predictionCol": "prediction", "seed": SEED}
    if model_type == "gbt":
        return GBTRegressor(**{"maxIter": 100, "stepSize": 0.1, **values}, **common)
    return RandomForestRegressor(**{"numTrees": 100, **values}, **common)


LEVELS = 256


def level(x: Column) -> Column:
    """A value scaled to [0, 1] as one byte; what lies outside goes to the nearest end. Trees only compare, in far fewer bins."""
    return (F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * (LEVELS - 1)) - LEVELS // 2).cast("tinyint")


@dataclass(frozen=True)
class Samples:
    """Samples of one length, written once for all trials: ``symbol, date, window`` (one byte a value), ``label``, ``role``; and the scaler."""

    rows: DataFrame
    scaler: DataFrame
    length: int

    def vectors(self, role: str) -> DataFrame:
        vector = array_to_vector(F.col("window").cast("array<double>")).alias("vector")
        return self.rows.filter(F.col("role") == role).select("symbol", "date", vector, "label")


def samples(
    table: DataFrame, length: int, features: Sequence[str] = FEATURES, target: str = TARGET, fit_on: str = "all", fraction: float = 0.8
) -> Samples:
    """Sequences of scaled features with the scaled target, from a feature table.

    ``fit_on="train"`` fits the scaler on the training part only.  Symbols with too few samples are left out.
    """
    clean = scrub(table, [*features, target])
    base = clean if fit_on == "all" else split_fraction(clean, fraction).filter("role = 'train'").drop("role")
    scaler = written(minmax_fit(base, [*features, target]), "scaler")
    scaled = minmax_apply(clean, scaler, [*features, target]).withColumns({c: level(F.col(c)) for c in features})
    seq = written(flat(sequences(scaled, features, target, length)), "samples")
    role = F.when(F.col("sample") < F.floor(F.col("samples") * F.lit(fraction)), "train").otherwise("test")
    rows = attach(seq, enough_samples(seq)).select("symbol", "date", F.col("sequence").alias("window"), F.col("y").alias("label"), role.alias("role"))
    return Samples(rows, scaler, length)


def errors(predicted: DataFrame, scaler: DataFrame, target: str = TARGET) -> DataFrame:
    """RMSE, MAE and the other metrics per symbol on the unscaled target."""
    y = minmax_inverse(predicted, scaler, "label", target, "y")
    return regression_metrics(minmax_inverse(y, scaler, "prediction", target, "p"))


def train(
    table: DataFrame,
    model_type: str,
    params: Mapping[str, str | int | float],
    features: Sequence[str] = FEATURES,
    target: str = TARGET,
    only: str | None = None,
    fit_on: str = "all",
    store: Samples | None = None,
):
    """Fit on the first 80 % of the samples; (model, samples, metrics per symbol on the rest).

    ``store`` holds the samples if another trial of the same length has made them.
    """
    length = int(params.get("sequence_length", 24))
    if store is None:
        store = samples(table if only is None else table.filter(F.col("symbol") == only), length, features, target, fit_on)
    elif store.length != length:
        raise ValueError(f"samples of {store.length} rows for a trial of {length}")
    model = estimator(model_type, params).fit(store.vectors("train"))
    return model, store, errors(model.transform(store.vectors("test")), store.scaler, target)


def run_trials(table: DataFrame, trials: Sequence[Mapping[str, str]], **options) -> tuple[DataFrame, dict[int, object]]:
    """Trial table (symbol, trial_id, model_type, params, rmse, mae) and the fitted models by trial id.

    The loop runs over the few trials; every fit is distributed. Trials of one sequence length share their samples.
    """
    table_rows, models, stores = None, {}, {}
    for trial_id, trial in enumerate(trials, 1):
        length = int(trial.get("sequence_length", 24))
        model, stores[length], metrics = train(table, trial["model_type"], trial, store=stores.get(length), **options)
        models[trial_id] = model
        settings = F.create_map(*[F.lit(str(x)) for k, v in trial.items() if k != "model_type" for x in (k, v)])
        rows = metrics.select(
            "symbol",
            F.lit(trial_id).cast("bigint").alias("trial_id"),
            F.lit(trial["model_type"]).alias("model_type"),
            settings.alias("params"),
            "rmse",
            "mae",
        )
        table_rows = rows if table_rows is None else table_rows.unionByName(rows)
    return table_rows, models


CHAMPION = "champion"  # what a publication is committed as


def publish(trial_rows: DataFrame, models: Mapping[int, object], scaler: DataFrame, path: str) -> DataFrame:
    """Write the champion of every symbol, the models that won and the scaler; returns the champion table.

    All of it goes to a folder of its own, and becomes the published version by one last write. A reader sees the version
    before or this one, never parts of both.
    """
    spark, version = trial_rows.sparkSession, versions.begin()
    folder = versions.folder(path, CHAMPION, version)
    champion(trial_rows).write.parquet(f"{folder}/champion")
    scaler.write.parquet(f"{folder}/scaler")
    winners = spark.read.parquet(f"{folder}/champion")
    for row in winners.select("trial_id").distinct().collect():  # at most one row per trial
        models[row.trial_id].write().save(f"{folder}/model/{row.trial_id}")
    versions.commit(spark, path, CHAMPION, version)
    return winners


@dataclass(frozen=True)
class Published:
    """The newest published version."""

    champions: DataFrame
    scaler: DataFrame
    folder: str

    def model(self, trial_id: int):
        return DefaultParamsReader.loadParamsInstance(f"{self.folder}/model/{trial_id}", self.champions.sparkSession)


def published(spark: SparkSession, path: str) -> Published | None:
    """What ``publish`` made visible last; None before the first publication."""
    version = versions.current(spark, path, CHAMPION)
    if version is None:
        return None
    folder = versions.folder(path, CHAMPION, version)
    return Published(spark.read.parquet(f"{folder}/champion"), spark.read.parquet(f"{folder}/scaler"), folder)


@dataclass(frozen=True)
class Search:
    """What a search found: ``scores`` (trial_id, split, score), ``rows`` with their positions, the best trial's id and
    its model fitted on all rows but the hold-out, and that model's metrics per symbol on the hold-out."""

    scores: DataFrame
    rows: DataFrame
    best: int
    model: object
    holdout: DataFrame


def search_rows(table: DataFrame, features: Sequence[str], target: str, holdout: int = 90) -> DataFrame:
    """``symbol, date, vector, label``, the row's position ``at`` in its series, and ``inside``, how many rows come before the hold-out. Each row once."""
    rows = table.select("symbol", "date", array_to_vector(F.array(*features)).alias("vector"), F.col(target).alias("label"))
    rows = with_state(rows, State()).withColumnRenamed("_rn", "at")
    sizes = rows.groupBy("symbol").agg(F.greatest(F.count("*") - holdout, F.lit(0)).alias("inside"))
    return attach(rows, sizes)


def fold(split: int, splits: int) -> tuple[Column, Column]:
    """Tests for the training and the test rows of fold ``split`` (from 1) of expanding folds: an interval of positions each."""
    size = F.floor(F.col("inside") / (splits + 1))
    start = F.col("inside") - (splits - split + 1) * size
    return F.col("at") < start, (F.col("at") >= start) & (F.col("at") < start + size)


def cv_search(
    table: DataFrame, trials: Sequence[Mapping[str, str]], splits: int = 5, features: Sequence[str] = FEATURES, target: str = TARGET, holdout: int = 90
) -> Search:
    """Negative mean absolute error of each setting on each expanding fold; the best one fitted anew and judged on the hold-out.

    The last ``holdout`` rows of each symbol take no part in the folds or any fit. The rows are written once, a fold is a filter.
    """
    rows = written(search_rows(table, features, target, holdout), "search-rows")
    mae = RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="mae")
    scores = []
    for trial_id, trial in enumerate(trials, 1):
        for split in range(1, splits + 1):
            before, test = fold(split, splits)
            model = estimator(trial["model_type"], trial).fit(rows.filter(before))
            scores.append((trial_id, split, -mae.evaluate(model.transform(rows.filter(test)))))
    means = {i: sum(s for t, _, s in scores if t == i) for i in range(1, len(trials) + 1)}
    best = max(means, key=lambda i: (means[i], -i))
    model = estimator(trials[best - 1]["model_type"], trials[best - 1]).fit(rows.filter("at < inside"))
    judged = model.transform(rows.filter("at >= inside")).select("symbol", F.col("label").alias("y"), F.col("prediction").alias("p"))
    table_of = table.sparkSession.createDataFrame(scores, "trial_id BIGINT, split INT, score DOUBLE")
    return Search(table_of, rows, best, model, regression_metrics(judged))


def mllib_scorer(model):
    """A model that ``train`` has fitted as the scorer of batch prediction; the windows are scaled."""

    def score(df: DataFrame) -> DataFrame:
        window = F.transform(F.flatten("sequence"), lambda x: level(x).cast("double"))
        return model.transform(df.withColumn("vector", array_to_vector(window))).drop("vector")

    return score
