"""Small cases with known answers."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schemas
from tickloom.functions import scalar as X
from tickloom.operators import bars as B
from tickloom.operators import columns as C
from tickloom.operators import drift as D
from tickloom.operators import news as N
from tickloom.operators import scoring as SC
from tickloom.operators import selection as L
from tickloom.operators import sequences as Q
from tickloom.operators import stats as ST
from tickloom.operators.upsert import upsert_keep_last
from tickloom.session import scratch_path
from tickloom.sources import logs as LG
from tickloom.sources.files import read_csv_loose, read_json_document, read_table, write_table

LISTED = ["AB", "CD.SA", "EF"]
D1, D2, D3 = dt.date(2026, 1, 1), dt.date(2026, 1, 2), dt.date(2026, 1, 3)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_sequences(spark):
    data = [("A", D1 + dt.timedelta(days=3 * i), 7.0 - i, 0.5 * i * i) for i in range(9)]
    df = spark.createDataFrame(data, "symbol string, date date, x double, t double")
    out = Q.sequences(df, ["x"], "t", 4).orderBy("sample").collect()
    assert len(out) == 9 - 4 - 1
    assert [r[0] for r in out[1].sequence] == [6.0, 5.0, 4.0, 3.0] and out[1].y == 0.5 * 25
    same_row = Q.sequences(df, ["x"], "t", 4, target_offset=0).orderBy("sample").collect()
    assert len(same_row) == 6 and same_row[0].y == 4.5
    assert Q.enough_samples(Q.sequences(df, ["x"], "t", 5)).count() == 0


def test_scoring_window_is_padded_on_the_left(spark):
    df = spark.createDataFrame([("A", D1, 1.0), ("A", D2, 2.0)], "symbol string, date date, x double")
    assert Q.scoring_window(df, ["x"], 4).first().sequence == [[0.0], [0.0], [1.0], [2.0]]


@pytest.mark.parametrize(
    "scores, want",
    [
        ([("neutral", 0.3), ("positive", 0.6), ("negative", 0.1)], 0.5),
        ([("Negative", 0.25), ("other", 0.75)], -0.25),
        ([], 0.0),
        (None, 0.0),
    ],
)
def test_polarity(spark, scores, want):
    df = spark.createDataFrame([("A", 1704110400, "h", scores)], schemas.NEWS)
    assert df.select(X.polarity("scores")).first()[0] == pytest.approx(want)


def test_sentiment_job_mean_and_merge(spark):
    day = 1704196800  # 2024-01-02 noon UTC
    news = spark.createDataFrame(
        [
            ("A", day, "up", [("positive", 1.0)]), ("A", day + 60, "down", [("negative", 0.5)]),
            ("A", day, "", [("positive", 9.0)]), ("A", day, None, [("positive", 9.0)]),
        ],
        schemas.NEWS,
    )
    old = spark.createDataFrame([("A", dt.date(2024, 1, 1), 0.1)], schemas.SENTIMENT)
    out = rows(N.sentiment_job(news, old, dt.date(2024, 1, 3)), "date")
    assert out == [("A", dt.date(2024, 1, 1), 0.1), ("A", dt.date(2024, 1, 2), 0.25)]


def test_scorer_slot(spark):
    import pandas as pd

    def classify(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"label": "positive" if "up" in t else "negative", "score": 1.0}])

    df = spark.createDataFrame([("up day",), ("bad day",)], "headline string")
    out = df.select("headline", X.polarity(N.scorer(classify)(F.col("headline"))).alias("p"))
    assert dict(rows(out)) == {"up day": 1.0, "bad day": -1.0}


def test_local_date_is_independent_of_session_zone(spark):
    df = spark.createDataFrame([(1704157200,)], "s bigint")  # 2024-01-02 01:00 UTC, still the 1st in Sao Paulo
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(X.epoch_local_date("s")).first()[0] == dt.date(2024, 1, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_lookback(spark):
    h = spark.createDataFrame([("A", D1)], "symbol string, date date")
    s = spark.createDataFrame([("A",), ("NEW",)], "symbol string")
    assert dict(rows(N.lookback_days(h, s, D1 + dt.timedelta(days=10)))) == {"A": 10, "NEW": 360}


def test_pointer(spark):
    p = spark.createDataFrame([("A", D1), ("B", D3)], "symbol string, last_date date")
    starts = {r.symbol: r.start_date for r in B.next_start(p, D3).collect()}
    assert starts == {"A": D2, "B": D3}
    empty = spark.createDataFrame([], "symbol string, date date")
    assert rows(B.update_pointer(p, empty), "symbol") == [("A", D1), ("B", D3)]
    full = spark.createDataFrame([("N", D1), ("N", D2)], "symbol string, date date")
    assert rows(B.update_pointer(p, full), "symbol")[-1] == ("N", D2)
    bars = spark.createDataFrame([(s, d) for s in "ABN" for d in (D1, D2, D3)], "symbol string, date date")
    assert B.bars_since(bars, p, D3).groupBy("symbol").count().orderBy("symbol").collect() == [("A", 2), ("B", 1), ("N", 3)]


def test_macro_end_is_padded_by_five_days(spark):
    days = [(D1 + dt.timedelta(days=i), "VIX", 1.0) for i in range(30)]
    out = B.macro_range(spark.createDataFrame(days, schemas.MACRO_LONG), D1, dt.date(2026, 1, 10))
    assert out.agg(F.max("date")).first()[0] == dt.date(2026, 1, 14)  # the end, the 15th, is exclusive


def test_macro_gap_gives_zero_twice(spark):
    data = [(D1, "VIX", 1.0), (D2, "SP500", 1.0), (D3, "VIX", 2.0), (D3 + dt.timedelta(days=1), "VIX", 4.0)]
    out = B.macro_returns(spark.createDataFrame(data, schemas.MACRO_LONG)).orderBy("date").collect()
    assert [round(r.VIX_Return, 6) for r in out] == [0.0, 0.0, 0.0, round(np.log(2), 6)]


def test_last_quote_and_output(spark):
    h = spark.createDataFrame([("A", D1, 100.0), ("A", D2, 102.0), ("A", D3, 105.0)], "symbol string, date date, close double")
    q = L.last_quote(h).withColumn("predicted_return", F.lit(float("nan")))
    out = SC.prediction_output(SC.forecast(q)).first()
    assert out.current_price == 105.0 and out.predicted_price_tomorrow is None and out.timestamp == "2026-01-03"


@pytest.mark.parametrize("share, want", [(0.1, False), (0.8, True), (0.5, True)])
def test_verdict(spark, share, want):
    flags = spark.createDataFrame([("A", f"f{i}", i < share * 10) for i in range(10)], "symbol string, feature string, drifted boolean")
    assert D.verdict(flags).first().dataset_drift is want


def two_sides(spark, shift):
    ref = spark.createDataFrame([("A", float(i), float(i % 7)) for i in range(200)], "symbol string, x double, y double")
    cur = spark.createDataFrame([("A", float(i) + shift, float(i % 7)) for i in range(200)], "symbol string, x double, y double")
    return ref, cur


@pytest.mark.parametrize("method", ["ks", "wasserstein", "psi"])
def test_drift_methods_see_a_shift_and_nothing_else(spark, method):
    ref, cur = two_sides(spark, 100.0)
    flags = {r.feature: r.drifted for r in D.drift(ref, cur, method).collect()}
    assert flags == {"x": True, "y": False}


def test_drift_values_against_brute_force(spark):
    ref, cur = two_sides(spark, 30.0)
    long = D.drift_input(ref, cur)
    sides = D.ordered_sides(long)
    a, b = np.arange(200.0), np.arange(200.0) + 30
    grid = np.union1d(a, b)
    f, g = np.searchsorted(a, grid, "right") / 200, np.searchsorted(b, grid, "right") / 200
    assert D.ks(sides).filter("feature = 'x'").first().statistic == pytest.approx(np.abs(f - g).max())
    want = np.sum(np.abs(f - g)[:-1] * np.diff(grid)) / a.std()
    assert D.wasserstein(sides, long).filter("feature = 'x'").first().statistic == pytest.approx(want)


def test_drift_gate_and_missing_column(spark):
    ref, cur = two_sides(spark, 0.0)
    assert D.drift(ref, cur.limit(4)).count() == 0
    assert D.drift(ref.filter("false"), cur).count() == 0
    assert D.drift(ref, cur.drop("y")).select("feature").collect() == [("x",)]
    filled = {r.feature: r.drifted for r in D.drift(ref, cur.drop("y"), missing="ref_mean").collect()}
    assert filled == {"x": False, "y": True}


def test_log_record(spark):
    base = spark.createDataFrame([("RACE", dt.datetime(2026, 5, 7, 12, 30), 55.5, 10500, 0.012)], "symbol string, ts timestamp, RSI_14 double, Volume bigint, SP500_Return double")
    df = base.withColumn("prediction_output", F.struct(F.lit(105.5).alias("predicted_price_tomorrow")))
    key = df.select(LG.log_key(F.col("symbol"), F.col("ts"))).first()[0]
    assert key == "predictions/RACE/2026-05-07T12-30-00-000000.json"
    rec = LG.build_log(df, ["RSI_14", "Volume", "SP500_Return"]).first()
    assert rec.model_version == "champion" and rec.features_input == {"RSI_14": 55.5, "Volume": 10500.0, "SP500_Return": 0.012}
    assert LG.build_log(df, []).first().features_input == {}


def test_logs_with_nan_null_and_missing_features(spark):
    path = scratch_path(spark, "logs")
    lines = [
        '{"symbol":"A","timestamp":"1","features_input":{"x":NaN,"y":1.0}}',
        '{"symbol":"A","timestamp":"2","features_input":{"x":null}}',
        '{"symbol":"A","timestamp":"3"}',
        '{"symbol":"A","timestamp":"4","features_input":{"x":2.0,"y":3.0},"prediction_output":{"message":"m"}}',
    ]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{path}/raw")
    df = spark.read.schema(schemas.PREDICTION_LOG).json(f"{path}/raw")
    flat = LG.flatten_features(df, ["x", "y"], keep=("timestamp",))
    assert rows(flat, "timestamp") == [("1", None, 1.0), ("2", None, None), ("4", 2.0, 3.0)]
    assert LG.newest(df, [F.col("timestamp").desc()], 1).first().timestamp == "4"


def test_files(spark):
    schema = T.StructType().add("symbol", "string").add("date", "date").add("x", "double")
    df = spark.createDataFrame([("A", D1, 1.5), ("B", D2, None)], schema)
    for fmt in ("csv", "json", "parquet", "orc"):
        path = scratch_path(spark, fmt)
        write_table(df, path, fmt)
        write_table(df, path, fmt)  # overwrites
        assert rows(read_table(spark, path, schema, fmt), "symbol") == [("A", D1, 1.5), ("B", D2, None)]
    assert read_table(spark, scratch_path(spark, "absent"), schema, "csv").count() == 0
    path = scratch_path(spark, "doc")
    spark.createDataFrame([('{\n  "symbol": "A",\n  "x": 2.5\n}',)], "v string").coalesce(1).write.text(path)
    assert read_json_document(spark, path, schema).first().x == 2.5
    stray = scratch_path(spark, "stray")
    df.withColumnRenamed("x", "Unnamed: 0").write.option("header", "true").csv(stray)
    assert read_csv_loose(spark, stray).columns == ["symbol", "date"]


def test_ticker_rules(spark):
    ok = spark.createDataFrame([(s,) for s in (*LISTED, schemas.INDEX_SYMBOL)], "symbol string")
    asked = spark.createDataFrame([(" ab ",), ("NONE9",)], "raw string").select(X.ticker("raw").alias("symbol"))
    assert C.allowed(asked.withColumn("n", F.lit(1)), ok).count() == 1
    assert rows(C.allowed(asked, ok)) == [("AB",)]
    assert rows(C.rejected(asked, ok)) == [("NONE9",)]
    assert L.without_index(ok).count() == len(LISTED)


def test_upsert_is_idempotent_and_new_wins(spark):
    old = spark.createDataFrame([("A", D1, 1.0), ("A", D2, 2.0)], "symbol string, date date, close double")
    new = spark.createDataFrame([("A", D2, 9.0), ("A", D3, 3.0)], "symbol string, date date, close double")
    once = upsert_keep_last(old, new)
    want = [("A", D1, 1.0), ("A", D2, 9.0), ("A", D3, 3.0)]
    assert rows(once, "date") == want and rows(upsert_keep_last(once, new), "date") == want


def test_scaler_roundtrip_and_constant_column(spark):
    df = spark.createDataFrame([("A", D1, 1.0, 5.0), ("A", D2, 3.0, 5.0)], "symbol string, date date, x double, c double")
    stats = Q.minmax_fit(df, ["x", "c"])
    scaled = Q.minmax_apply(df, stats, ["x", "c"])
    assert rows(scaled.select("x", "c"), "x") == [(0.0, 0.0), (1.0, 0.0)]
    back = Q.minmax_inverse(Q.minmax_inverse(scaled, stats, "x", "x", "x"), stats, "c", "c", "c")
    assert rows(back.select("x", "c"), "x") == [(1.0, 5.0), (3.0, 5.0)]
    assert SC.scaler_matches(stats, ["c", "x"]) and not SC.scaler_matches(stats, ["x"])


def test_folds_and_splits(spark):
    df = spark.createDataFrame([("A", D1 + dt.timedelta(days=i)) for i in range(20)], "symbol string, date date")
    folds = Q.expanding_folds(df).groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("a"), F.count_if(F.col("role") == "test").alias("b"))
    assert rows(folds, "fold") == [(1, 5, 3), (2, 8, 3), (3, 11, 3), (4, 14, 3), (5, 17, 3)]
    assert Q.split_fraction(df).filter("role = 'train'").count() == 16
    assert Q.split_last(df, 90).filter("role = 'train'").count() == 0


def test_statistics_on_a_constant_series(spark):
    df = spark.createDataFrame([("A", D1 + dt.timedelta(days=i), 5.0, float(i)) for i in range(5)], "symbol string, date date, a double, b double")
    assert {r.corr for r in ST.corr_long(df, ["a", "b"], lower_only=True).collect()} == {None}
    assert ST.histogram(df, "a", 10).collect() == [("A", 0, 5)]
    returns = df.select("symbol", "date", (F.col("a") * 0).alias("log_return"))
    assert ST.return_stats(returns).first().sharpe is None


def test_pacf_against_literal_recursion(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    for i in range(1, 300):
        x[i] += 0.6 * x[i - 1]
    df = spark.createDataFrame([("A", D1 + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)], "symbol string, date date, log_return double")
    acf = ST.acf(df, nlags=10)
    r = [v.acf for v in acf.orderBy("lag").collect()]
    assert r[0] == 1.0
    want = [1.0]
    for k in range(1, 11):  # solve the Yule-Walker equations of each order
        m = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        want.append(np.linalg.solve(m, r[1 : k + 1])[-1])
    got = [v.pacf for v in ST.pacf(acf).orderBy("lag").collect()]
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_additive_decomposition_recovers_a_season(spark):
    season = [3.0, -1.0, -2.0, 0.0]
    df = spark.createDataFrame([("A", D1 + dt.timedelta(days=i), 100 + 2.0 * i + season[i % 4]) for i in range(40)], "symbol string, date date, close double")
    out = ST.seasonal_decompose(df, period=4, multiplicative=False, size=7).orderBy("date").collect()
    assert out[0].trend is None and out[10].trend == pytest.approx(120.0)
    assert [round(out[i].seasonal, 9) for i in range(4)] == season
    assert out[10].resid == pytest.approx(0.0, abs=1e-9)


def test_trials_are_repeatable(spark):
    s = spark.createDataFrame([("A",), ("B",)], "symbol string")
    first = rows(Q.sample_trials(s), "symbol", "trial")
    assert len(first) == 10 and first == rows(Q.sample_trials(s), "symbol", "trial")
    assert first != rows(Q.sample_trials(s, seed=7), "symbol", "trial")


def test_champion_takes_the_least_error(spark):
    t = spark.createDataFrame([("A", 2, 0.1), ("A", 1, 0.1), ("A", 3, 0.5), ("A", 4, None)], "symbol string, trial_id bigint, rmse double")
    assert rows(L.champion(t)) == [("A", 1, 0.1)]


def test_transformer_in_a_pipeline(spark):
    from pyspark.ml import Pipeline, PipelineModel

    from tickloom.operators.features import features
    from tickloom.operators.transformer import FeatureTable

    data = [("A", D1 + dt.timedelta(days=i), 1.0, 3.0, 0.5, 2.0 + (i * 7) % 5, 10 + i) for i in range(70)]
    bars = spark.createDataFrame(data, schemas.BARS)
    bars.select("date", F.lit(0.5).alias("SP500_Return"), F.lit(0.0).alias("VIX_Return"), F.lit(0.0).alias("EURUSD_Return")).createOrReplaceTempView("macro_view")
    model = Pipeline(stages=[FeatureTable(training=False, macroTable="macro_view")]).fit(bars)
    path = scratch_path(spark, "model")
    model.save(path)
    out = PipelineModel.load(path).transform(bars)
    assert out.count() == features(bars, training=False).count() == 21
    assert out.first().SP500_Return == 0.5


def test_training_trials_publish_and_score(spark):
    from tickloom.operators import modeling as M
    from tickloom.operators.features import features

    rng = np.random.default_rng(2)
    data = []
    for s in ("A", "B"):
        price = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 200)))
        data += [(s, D1 + dt.timedelta(days=i), float(p), float(p * 1.01), float(p * 0.99), float(p), int(100 + i % 9)) for i, p in enumerate(price)]
    bars = spark.createDataFrame(data, schemas.BARS)
    table = features(bars)
    trials = [
        {"model_type": "gbt", "n_estimators": "2", "max_depth": "2", "learning_rate": "0.1", "sequence_length": "3"},
        {"model_type": "random_forest", "n_estimators": "3", "max_depth": "2", "sequence_length": "3"},
    ]
    results, models = M.run_trials(table, trials)
    assert results.count() == 4 and results.filter("rmse >= mae AND mae > 0").count() == 4
    scaler = Q.minmax_fit(table, [*schemas.FEATURES, schemas.TARGET])
    best = M.publish(results, models, scaler, scratch_path(spark, "champion"))
    assert best.count() == 2
    out = SC.predict_batch(bars, None, None, M.mllib_scorer(models[1]), 3, scaler).collect()
    assert len(out) == 2 and all(r.scaler_applied and abs(r.variation_pct) < 10 for r in out)


def test_stream_upsert_survives_a_repeated_batch(spark):
    from tickloom.streaming import jobs

    path = scratch_path(spark, "versions")
    write = jobs.versioned_sink(path)
    old = spark.createDataFrame([("A", D1, 1.0, 1.0, 1.0, 1.0, 1)], schemas.BARS)
    new = spark.createDataFrame([("A", D1, 2.0, 2.0, 2.0, 2.0, 2), ("A", D2, 3.0, 3.0, 3.0, 3.0, 3)], schemas.BARS)
    for df, batch in ((old, 0), (new, 1), (new, 1)):
        write(df, batch)
    out = jobs.read_versions(spark, path, schemas.BARS, ["symbol", "date"])
    assert rows(out.select("date", "close"), "date") == [(D1, 2.0), (D2, 3.0)]


def test_absent_logs_read_as_empty(spark):
    logs = LG.read_logs(spark, scratch_path(spark, "no-logs"))
    assert logs.count() == 0 and "mtime" in logs.columns


def test_stream_upsert_takes_the_newest_row_of_a_batch(spark):
    from tickloom.streaming import jobs

    path = scratch_path(spark, "one-batch")
    for close in (1.0, 2.0, 3.0):
        df = spark.createDataFrame([("A", D1, close, close, close, close, 1), ("B", D1, 5.0, 5.0, 5.0, 5.0, 1)], schemas.BARS)
        df.coalesce(1).write.mode("append").parquet(f"{path}/inbox")
        time.sleep(0.05)
    for n in (None, 1):
        stream = jobs.delivered(jobs.file_stream(spark, f"{path}/inbox", schemas.BARS, files_per_trigger=n))
        jobs.upsert_history(stream, f"{path}/table{n}", f"{path}/checkpoint{n}")
        out = jobs.read_versions(spark, f"{path}/table{n}", schemas.BARS, ["symbol", "date"])
        assert rows(out.select("symbol", "close"), "symbol") == [("A", 3.0), ("B", 5.0)]
    jobs.compact(spark, f"{path}/table1", schemas.BARS, ["symbol", "date"], f"{path}/compact")
    assert rows(jobs.read_versions(spark, f"{path}/compact", schemas.BARS, ["symbol", "date"]).select("close"), "close") == [(3.0,), (5.0,)]


def test_settings_that_a_model_lacks_are_errors():
    from tickloom.operators import modeling as M

    assert M.estimator("random_forest", {"max_depth": "-1", "learning_rate": "0.1"}).getMaxDepth() == M.MAX_DEPTH
    assert M.estimator("gbt", {"subsample": "0.8", "min_child_samples": "7"}).getMinInstancesPerNode() == 7
    for kind, settings in (("gbt", {"max_depth": "31"}), ("gbt", {"num_leaves": "9"}), ("svm", {})):
        with pytest.raises(ValueError):
            M.estimator(kind, settings)


def test_more_parts_than_a_thousand(spark, monkeypatch):
    from tickloom.operators import ordered

    monkeypatch.setattr(ordered, "ROWS_PER_PART", 2)
    values = spark.range(3000).select(F.lit("A").alias("k"), (F.col("id") * 7 % 3001).cast("double").alias("v"))
    found = ordered.cumulative(values, ["k"], "v", {"n": F.lit(1)}).toPandas().sort_values("v")
    assert (found.n_upto.to_numpy() == range(1, 3001)).all() and (found.next_value.to_numpy()[:-1] == found.v.to_numpy()[1:]).all()
