"""Training windows, scaling, chronological splits and error metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalar import ratio
from tickloom.operators.ordered import cumulative
from tickloom.operators.selection import tail
from tickloom.operators.series import attach, number_rows, windowed

MIN_SAMPLES = 50


def minmax_fit(df: DataFrame, columns: Sequence[str], key: str = "symbol") -> DataFrame:
    """Minimum and maximum of each column per key: one row per key."""
    return df.groupBy(key).agg(*[x for c in columns for x in (F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"))])


def _width(c: str) -> Column:
    width = F.col(f"{c}_max") - F.col(f"{c}_min")
    return F.when(width == 0, 1.0).otherwise(width)


def minmax_value(column: str) -> Column:
    """A column scaled to [0, 1] by the minimum and maximum beside it; a constant column becomes 0."""
    return (F.col(column) - F.col(f"{column}_min")) / _width(column)


def minmax_original(scaled: str, column: str) -> Column:
    """The value of ``column`` that ``scaled`` stands for."""
    return F.col(scaled) * _width(column) + F.col(f"{column}_min")


def minmax_apply(df: DataFrame, stats: DataFrame, columns: Sequence[str], key: str = "symbol") -> DataFrame:
    """Scale to [0, 1]; a constant column becomes 0."""
    scaled = {c: minmax_value(c) for c in columns}
    needed = stats.select(key, *[f"{c}_{s}" for c in columns for s in ("min", "max")])
    return attach(df, needed, key).withColumns(scaled).drop(*[c for c in needed.columns if c != key])


def minmax_inverse(df: DataFrame, stats: DataFrame, scaled: str, column: str, out: str, key: str = "symbol") -> DataFrame:
    """Undo the scaling of ``column`` for the values in ``scaled``."""
    needed = stats.select(key, f"{column}_min", f"{column}_max")
    return (
        attach(df, needed, key)
        .withColumn(out, minmax_original(scaled, column))
        .drop(f"{column}_min", f"{column}_max")
    )


def sequences(
    df: DataFrame, features: Sequence[str], target: str, length: int, target_offset: int = 1, key: str = "symbol"
) -> DataFrame:
    """(symbol, date, sample, sequence, y): ``length`` rows of features and the target ``target_offset`` rows after the last.

    With the default offset a series of n rows gives n - length - 1 samples: the last possible one is left out.
    """
    ahead = 2 if target_offset == 1 else target_offset

    def build(d, w):
        frame = w.rowsBetween(-(length - 1), 0)
        d = d.withColumns(
            {
                "sequence": F.collect_list(F.array(*features)).over(frame),
                "y": F.lead(target, target_offset).over(w) if target_offset else F.col(target),
                "_more": F.lead("_rn", ahead).over(w) if ahead else F.col("_rn"),
            }
        )
        return d

    out = windowed(df.select(key, "date", *features, target), build, before=length - 1, after=ahead, key=key, keep=("_rn",))
    full = (F.col("_rn") >= length - 1) & F.col("_more").isNotNull()
    return out.filter(full).select(key, "date", (F.col("_rn") - (length - 1)).alias("sample"), "sequence", "y")


def flat(df: DataFrame) -> DataFrame:
    """Sequences as one row-major array per sample."""
    return df.withColumn("sequence", F.flatten("sequence"))


def scoring_window(df: DataFrame, features: Sequence[str], length: int) -> DataFrame:
    """The last ``length`` feature rows per symbol as a sequence, filled up on the left with zeros."""
    rows = tail(df, length).groupBy("symbol").agg(
        F.max("date").alias("date"), F.sort_array(F.collect_list(F.struct("date", F.array(*features).alias("x")))).alias("_r")
    )
    zeros = F.array(*[F.lit(0.0)] * len(features))
    padding = F.array_repeat(zeros, F.lit(length) - F.size("_r"))
    return rows.select("symbol", "date", F.concat(padding, F.transform("_r", lambda r: r["x"])).alias("sequence"))


def _positions(df: DataFrame, key: str, order: str) -> DataFrame:
    rows = number_rows(df, key, order, out="_at")
    return attach(rows, df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key, order)


def split_fraction(df: DataFrame, fraction: float = 0.8, key: str = "symbol", order: str = "date") -> DataFrame:
    """Add ``role``: the first part of each series is train, the rest test."""
    role = F.when(F.col("_at") < F.floor(F.col("_n") * F.lit(fraction)), "train").otherwise("test")
    return _positions(df, key, order).withColumn("role", role).drop("_at", "_n")


def split_last(df: DataFrame, rows: int = 90, key: str = "symbol", order: str = "date") -> DataFrame:
    """Add ``role``: the last ``rows`` rows of each series are test."""
    role = F.when(F.col("_at") < F.col("_n") - rows, "train").otherwise("test")
    return _positions(df, key, order).withColumn("role", role).drop("_at", "_n")


def expanding_folds(df: DataFrame, splits: int = 5, key: str = "symbol", order: str = "date") -> DataFrame:
    """One row per fold a row takes part in: fold k tests one stretch and trains on everything before it."""
    test = F.floor(F.col("_n") / (splits + 1))
    folds = F.array(
        *[F.struct(F.lit(k + 1).alias("fold"), (F.col("_n") - (splits - k) * test).alias("start")) for k in range(splits)]
    )
    used = F.filter(folds, lambda f: F.col("_at") < f["start"] + test)
    rows = _positions(df, key, order).withColumn("_test", test).withColumn("_fold", F.explode(used))
    role = F.when(F.col("_at") < F.col("_fold.start"), "train").otherwise("test")
    return rows.withColumns({"fold": F.col("_fold.fold"), "role": role}).drop("_at", "_n", "_test", "_fold")


def enough_samples(df: DataFrame, minimum: int = MIN_SAMPLES, key: str = "symbol") -> DataFrame:
    """Keys with at least ``minimum`` samples, and how many."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("samples")).filter(F.col("samples") >= minimum)


def regression_metrics(df: DataFrame, y: str = "y", p: str = "p", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """RMSE, MAE, hit rate in percent, R2 and MAPE, in one pass."""
    error = F.col(y) - F.col(p)
    spread = F.var_pop(y) * F.count(y)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        (F.avg((F.signum(y) == F.signum(p)).cast("double")) * 100).alias("hit_rate"),
        (1 - ratio(F.sum(error * error), spread)).alias("r2"),
        F.avg(F.abs(ratio(error, y))).alias("mape"),
    )


def cv_rank(scores: DataFrame, keys: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """Mean, population deviation and rank (1 is the highest mean, ties share the lowest) of the split scores per trial."""
    summary = scores.groupBy(*keys, "trial_id").agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score")
    )
    placed = summary.withColumn("_m", F.round("mean_score", digits)).withColumn("_all", F.lit(1))
    order = cumulative(placed, [*keys, "_all"], "_m", {"_c": F.lit(1)})
    ranks = order.select(*keys, "_m", (F.col("_c_total") - F.col("_c_upto") + 1).alias("rank"))
    return placed.join(ranks, [*keys, "_m"]).select(*keys, "trial_id", "mean_score", "std_score", "rank")


# The searched parameter grids and the defaults for parameters an algorithm does not search.
SEARCH_SPACE: dict[str, dict[str, list]] = {
    "gbt": {
        "learning_rate": ["0.1", "0.05", "0.01"],
        "n_estimators": ["100", "300", "500"],
        "max_depth": ["3", "5", "7", "10", "15"],
        "sequence_length": ["24"],
    },
    "random_forest": {
        "n_estimators": ["100", "300", "500"],
        "max_depth": ["5", "10", "20", "30"],
        "sequence_length": ["24"],
    },
}
TRIAL_DEFAULTS = {"learning_rate": "0.01", "n_estimators": "100", "max_depth": "5", "sequence_length": "24"}
# End of fixed values.
TRIALS = 5


def sample_trials(
    symbols: DataFrame,
    n: int = TRIALS,
    seed: int = 42,
    space: Mapping[str, Mapping[str, Sequence[str]]] = SEARCH_SPACE,
) -> DataFrame:
    """``n`` settings per symbol: an algorithm is drawn first, each as likely, then a value of each of its parameters; defaults fill the rest.

    A draw takes the choice with the smallest hash of seed, symbol, trial, name and choice, so it is repeatable on any cluster.
    """

    def drawn(name: str, choices: Sequence[str]) -> Column:
        hashed = [F.struct(F.md5(F.concat_ws("-", F.lit(str(seed)), "symbol", "trial", F.lit(name), F.lit(c))).alias("h"), F.lit(c).alias("c")) for c in choices]
        return F.array_min(F.array(*hashed))["c"]

    names = ["model_type", *TRIAL_DEFAULTS]
    trials = symbols.select("symbol", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("trial")).withColumn("model_type", drawn("model_type", list(space)))
    for name, default in TRIAL_DEFAULTS.items():
        value = F.lit(default)
        for model, axes in space.items():
            if name in axes:
                value = F.when(F.col("model_type") == model, drawn(name, axes[name])).otherwise(value)
        trials = trials.withColumn(name, value)
    return trials.select("symbol", "trial", *names)
