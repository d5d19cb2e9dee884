"""Blocked windows against plain pandas over the whole series, with blocks small enough to have many."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import rolling as R
from tickloom.operators import features as FT
from tickloom.operators import indicators
from tickloom.operators.averages import with_averages
from tickloom.operators.ordered import cumulative, quantiles
from tickloom.operators.series import attach, exclusive_prefix, forward_fill, number_rows, running_max, running_sum, windowed


def make_bars(spark, lengths, seed=1):
    rng = np.random.default_rng(seed)
    parts = []
    for symbol, n in lengths.items():
        dates = pd.to_datetime("1990-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 4, n)), unit="D")
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        parts.append(
            pd.DataFrame(
                {
                    "symbol": symbol, "date": dates.date, "open": close * 0.99, "high": close * 1.02,
                    "low": close * 0.97, "close": close, "volume": rng.integers(1, 1000, n),
                }
            )
        )
    pdf = pd.concat(parts, ignore_index=True)
    return spark.createDataFrame(pdf), pdf


@pytest.fixture(scope="module")
def bars(spark):
    df, pdf = make_bars(spark, {"HOT": 3000, "A": 200, "B": 51, "ONE": 1})
    return df.cache(), pdf


def sorted_pdf(df):
    return df.toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)


def test_numbering(bars):
    df, pdf = bars
    got = sorted_pdf(number_rows(df, chunk_days=100))
    assert (got._rn == got.groupby("symbol").cumcount()).all()
    assert len(got) == len(pdf)


def test_numbering_of_a_hot_hour(spark):
    """All rows of a key in one hour: numbered right, and no part holds them."""
    ticks = spark.range(20_000).select(F.lit("HOT").alias("symbol"), F.timestamp_micros(F.col("id") * 7919 % 20_011 * 170_000).alias("ts"))
    ticks = ticks.unionByName(spark.range(5).select(F.lit("COLD").alias("symbol"), F.timestamp_micros("id").alias("ts")))
    numbered = number_rows(ticks, order="ts")
    got = numbered.toPandas().sort_values(["symbol", "ts"])
    assert (got._rn == got.groupby("symbol").cumcount()).all() and len(got) == 20_005
    path = sorted(set(numbered.inputFiles()))
    rows = [r["n"] for r in spark.read.parquet(*path).groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert len(rows) > 4 and max(rows) < 6000
    sums = windowed(ticks.withColumn("x", F.lit(1.0)), lambda d, w: d.withColumn("s", F.sum("x").over(w.rowsBetween(-9, 0))), before=9, order="ts", size=64)
    assert sums.filter("s = 10").count() == 20_000 - 9


@pytest.mark.parametrize("size", [60, 777, 2048])
def test_rolling_lag_and_lead_cross_block_borders(bars, size):
    df, _ = bars

    def build(d, w):
        return d.withColumns(
            {"sma": R.sma("close", 50, w), "std": R.rolling_std("close", 20, w), "lag5": F.lag("close", 5).over(w), "lead2": F.lead("close", 2).over(w)}
        )

    got = sorted_pdf(windowed(df, build, before=50, after=2, size=size))
    g = got.groupby("symbol").close
    for column, want in {
        "sma": g.transform(lambda x: x.rolling(50).mean()),
        "std": g.transform(lambda x: x.rolling(20).std()),
        "lag5": g.shift(5),
        "lead2": g.shift(-2),
    }.items():
        np.testing.assert_allclose(got[column].astype(float), want, rtol=1e-9, err_msg=column)


@pytest.mark.parametrize("size, fan", [(64, 4), (2048, 1024)])
def test_averages_equal_recursion(bars, size, fan):
    df, _ = bars
    spans = [1, 2, 9, 26, 50, 1000]
    got = sorted_pdf(with_averages(df, {f"e{s}": ("close", s) for s in spans}, size=size, fan=fan))
    for s in spans:
        want = got.groupby("symbol").close.transform(lambda x: x.ewm(span=s, adjust=False).mean())
        np.testing.assert_allclose(got[f"e{s}"], want, rtol=1e-11, err_msg=str(s))


def test_rsi_keeps_its_value_over_a_flat_stretch(spark):
    """300 moving days, then a flat close: the averages shrink together, their ratio stays."""
    rng = np.random.default_rng(4)
    close = np.concatenate([100 + np.cumsum(rng.normal(size=300)), np.full(4000, 100.0)])
    days = pd.DataFrame({"symbol": "A", "date": pd.date_range("2000-01-01", periods=len(close)).date, "close": close})
    got = sorted_pdf(indicators.rsi(spark.createDataFrame(days)))
    delta = pd.Series(close).diff().fillna(0)
    up, down = (x.ewm(span=14, adjust=False).mean() for x in (delta.clip(lower=0), (-delta).clip(lower=0)))
    np.testing.assert_allclose(got.RSI_14[1:], (100 - 100 / (1 + up / down))[1:], rtol=1e-7)


def test_average_of_null_is_an_error(spark):
    holes = spark.createDataFrame([("A", dt.date(2020, 1, d), None if d == 3 else 1.0) for d in range(1, 6)], "symbol string, date date, close double")
    with pytest.raises(Exception, match="fill it before averaging"):
        indicators.ema(holes, [3]).collect()


def test_running_sum_and_max(bars):
    df, _ = bars
    total = sorted_pdf(running_sum(df, R.signed_volume, "obv", before=1, size=64))
    sign = np.sign(total.groupby("symbol").close.diff().fillna(0))
    assert (total.obv == (sign * total.volume).groupby(total.symbol).cumsum()).all()
    peak = sorted_pdf(running_max(df, "close", "peak", size=64))
    assert (peak.peak == peak.groupby("symbol").close.cummax()).all()


def test_forward_fill(bars):
    df, _ = bars
    holes = df.select("symbol", "date", F.when(F.dayofmonth("date") == 3, F.col("close")).alias("x"))
    got, base = sorted_pdf(forward_fill(holes, ["x"], size=16)), sorted_pdf(holes)
    np.testing.assert_array_equal(got.x, base.groupby("symbol").x.ffill())


def test_prefix_over_many_groups(spark):
    parts = spark.range(1000).select(F.lit("a").alias("symbol"), F.col("id").alias("_block"), F.col("id").alias("v"))
    got = exclusive_prefix(parts, {"v": F.sum}, fan=7).toPandas().sort_values("_block").v
    want = np.cumsum(np.arange(1000)) - np.arange(1000)
    assert got.isna().sum() == 1 and (got.iloc[1:].astype(int).to_numpy() == want[1:]).all()


def test_attach_keeps_every_row_once(bars):
    df, pdf = bars
    stats = df.groupBy("symbol").agg(F.max("close").alias("top"))
    assert attach(df, stats).count() == len(pdf)
    assert attach(df, stats.filter("symbol = 'A'"), how="left").count() == len(pdf)


@pytest.mark.parametrize("parts", [1, 5, 64])
def test_value_order_totals_and_quantiles(spark, parts):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"symbol": rng.choice(["x", "y"], 4000, p=[0.9, 0.1]), "v": np.round(rng.exponential(3, 4000), 2)})
    pdf.loc[:1300, "v"] = 1.5  # a third of all rows has one value
    df = spark.createDataFrame(pdf)
    got = cumulative(df, ["symbol"], "v", {"n": F.lit(1)}, parts).toPandas().sort_values(["symbol", "v"]).reset_index(drop=True)
    want = pdf.groupby(["symbol", "v"]).size()
    assert (got.n.to_numpy() == want.to_numpy()).all()
    assert (got.n_upto.to_numpy() == want.groupby("symbol").cumsum().to_numpy()).all()
    np.testing.assert_array_equal(got.next_value, got.groupby("symbol").v.shift(-1))
    q = quantiles(df, ["symbol"], "v", {"a": 0.01, "b": 0.5, "c": 0.99}, parts).toPandas().set_index("symbol").sort_index()
    np.testing.assert_allclose(q, pdf.groupby("symbol").v.quantile([0.01, 0.5, 0.99]).unstack(), rtol=1e-12)


def test_features_do_not_depend_on_block_size(bars):
    df, _ = bars
    small = sorted_pdf(FT.features(df, training=False, size=750))
    large = sorted_pdf(FT.features(df, training=False, size=2048))
    assert len(small) == len(large) > 3000
    for c in FT.columns_of(FT.FULL):
        np.testing.assert_allclose(small[c].astype(float), large[c].astype(float), rtol=1e-7, atol=1e-9, err_msg=c)


def test_feature_invariants(bars):
    df, _ = bars
    f = sorted_pdf(FT.features(df, training=False))
    hot = f[f.symbol == "HOT"]
    assert ((hot.RSI_14 >= 0) & (hot.RSI_14 <= 100)).all()
    np.testing.assert_allclose(hot.MACD_Histogram, hot.MACD_Line - hot.MACD_Signal, atol=1e-12)
    np.testing.assert_allclose(hot.Month_Sin**2 + hot.Month_Cos**2, 1)
    assert len(f[f.symbol == "ONE"]) == 1  # too short for a complete row: kept with zeros
    assert f[f.symbol == "ONE"].Log_Return.iloc[0] == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_key_is_split_even_if_input_is_partitioned_by_it(bars):
    df, _ = bars
    text = plan(windowed(df.repartition("symbol"), lambda d, w: d.withColumn("s", R.sma("close", 5, w)), before=4))
    assert "hashpartitioning(symbol" in text and "_block" in text
    for line in text.splitlines():
        if "Exchange hashpartitioning(symbol" in line and "REPARTITION_BY_COL" in line:
            break
    else:
        raise AssertionError(text)


def test_feature_plan_has_no_python_and_no_single_partition_window(spark, sf):
    from tickloom.plans import QUERIES

    text = plan(QUERIES["features_full"](spark, sf))
    assert "EvalPython" not in text and "InPandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
