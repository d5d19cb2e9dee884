"""State that moves on: recurrences over whole histories, committed versions, streams with bounded state, sketches."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.operators import indicators, recurrences
from tickloom.operators import drift as D
from tickloom.operators import features as FT
from tickloom.operators import modeling as M
from tickloom.operators import news as N
from tickloom.operators import scoring as SC
from tickloom.operators import sequences as Q
from tickloom.operators import sketches as SK
from tickloom.operators import stats as ST
from tickloom.session import scratch_path
from tickloom.sources import logs as LG
from tickloom.sources import versions
from tickloom.streaming import jobs

START = dt.date(2010, 1, 1)


def history(seed=5, sizes=(("HOT", 700, 3), ("RARE", 60, 90), ("ONE", 1, 1))):
    """Bars with gaps: the rare symbol has a few rows in each chunk."""
    rng = np.random.default_rng(seed)
    frames = []
    for symbol, n, gap in sizes:
        days = np.cumsum(rng.integers(1, gap + 1, n))
        close = np.round(50 + np.cumsum(rng.choice([-1.0, 0.0, 1.5], n)) + 200, 2)
        frames.append(
            pd.DataFrame(
                {"symbol": symbol, "date": [START + dt.timedelta(days=int(d)) for d in days], "open": close, "high": close + rng.random(n), "low": close - rng.random(n), "close": close, "volume": rng.integers(1, 900, n)}
            )
        )
    return pd.concat(frames, ignore_index=True)


def expected(pdf):
    out = []
    for _, g in pdf.sort_values("date").groupby("symbol"):
        g = g.copy()
        e = lambda x, s: x.ewm(span=s, adjust=False).mean()
        g["_fast"], g["_slow"] = e(g.close, 12), e(g.close, 26)
        g["MACD_Signal"] = e(g._fast - g._slow, 9)
        delta = g.close.diff().fillna(0)
        g["_g"], g["_l"] = e(delta.clip(lower=0), 14), e((-delta).clip(lower=0), 14)
        g["OBV"] = (np.sign(delta) * g.volume).cumsum().astype("int64")
        g["_rn"] = np.arange(len(g))
        out.append(g)
    return pd.concat(out).sort_values(["symbol", "date"]).reset_index(drop=True)


@pytest.mark.parametrize("days", [5, 64, 2048])
def test_state_equals_recursion(spark, monkeypatch, days):
    monkeypatch.setattr(recurrences, "CHUNK_DAYS", days)
    pdf = history()
    state = indicators.oscillator_state(obv=True)
    got = recurrences.with_state(spark.createDataFrame(pdf), state).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    want = expected(pdf)
    assert len(got) == len(want)
    for c in [*state.names, "_rn"]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-10, atol=1e-10, err_msg=c)


def test_bounded_state_equals_recursion(spark):
    pdf = history()
    state = indicators.oscillator_state(obv=True)
    got = recurrences.with_state_bounded(spark.createDataFrame(pdf), state).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True)
    want = expected(pdf)
    for c in [*state.names, "_rn"]:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-10, atol=1e-10, err_msg=c)


def test_equal_spans_in_signal(spark, monkeypatch):
    """The signal's span may be that of one of its averages."""
    monkeypatch.setattr(recurrences, "CHUNK_DAYS", 40)
    pdf = history(sizes=(("A", 300, 2),))
    got = indicators.macd(spark.createDataFrame(pdf), 9, 20, 9).toPandas().sort_values("date")
    line = pdf.close.ewm(span=9, adjust=False).mean() - pdf.close.ewm(span=20, adjust=False).mean()
    np.testing.assert_allclose(got.MACD_Signal, line.ewm(span=9, adjust=False).mean(), rtol=1e-9, atol=1e-11)


def test_bounded_features_equal_the_others(spark):
    bars = spark.createDataFrame(history(), schemas.BARS)
    whole, tail = (FT.features(bars, training=False, bounded=b).toPandas().sort_values(["symbol", "date"]).reset_index(drop=True) for b in (False, True))
    assert len(whole) == len(tail) > 600
    for c in [*schemas.FEATURES, schemas.TARGET]:
        np.testing.assert_allclose(whole[c].astype(float), tail[c].astype(float), rtol=1e-8, atol=1e-9, err_msg=c)


@pytest.mark.parametrize("name", ["features_full", "features_inference_mode", "macd", "rsi_14", "batch_predict", "acf_40", "pacf_40"])
def test_ticks_are_read_once(spark, sf, name):
    from tickloom.plans import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("orders.parquet") <= 1


def test_autocorrelation_with_a_missing_value(spark):
    x = np.sin(np.arange(200)) + 3
    x[50] = np.nan
    days = [("A", START + dt.timedelta(days=i), None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
    got = ST.acf(spark.createDataFrame(days, "symbol string, date date, log_return double"), nlags=5).toPandas().sort_values("lag")
    d = x - np.nanmean(x)
    want = [np.nansum(d[k:] * d[: len(d) - k]) / np.nansum(d * d) for k in range(6)]
    np.testing.assert_allclose(got.acf, want, rtol=1e-9)


# Committed versions


def log_rows(spark, symbols, price):
    scored = spark.createDataFrame([(s, price, START, 0.01) for s in symbols], "symbol string, last_price double, last_date date, predicted_return double")
    scored = SC.forecast(scored).withColumns({"ts": F.lit("2026-01-02 03:04:05").cast("timestamp_ntz"), "x": F.lit(1.5)})
    return SC.log_records(scored, ["x"])


def test_a_retried_job_adds_no_second_log(spark, monkeypatch):
    path = scratch_path(spark, "log")
    assert LG.read_jobs(spark, path).count() == 0
    LG.append_job(log_rows(spark, "AB", 1.0), path, "day-1")
    with monkeypatch.context() as m:  # the next job stops after its records and before its commit
        m.setattr(versions, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            LG.append_job(log_rows(spark, "ABC", 2.0), path, "day-2")
    assert LG.read_jobs(spark, path).count() == 2
    for _ in range(2):
        LG.append_job(log_rows(spark, "ABC", 3.0), path, "day-2")
    logs = LG.read_jobs(spark, path).select("job", "symbol", "prediction_output.current_price", F.col("features_input")["x"].alias("x")).collect()
    assert sorted(map(tuple, logs)) == [("day-1", "A", 1.0, 1.5), ("day-1", "B", 1.0, 1.5), *[("day-2", s, 3.0, 1.5) for s in "ABC"]]
    with pytest.raises(ValueError):
        LG.append_job(log_rows(spark, "A", 1.0), path, "../other")


def test_a_fitted_model_scores_all_symbols(spark):
    from pyspark.ml.regression import LinearRegression

    bars = spark.createDataFrame(history(sizes=(("A", 200, 2), ("B", 120, 2))), schemas.BARS)
    recent = SC.recent_history(bars)
    scaler = SC.batch_scaler(recent, None, None)
    weights = np.round(np.random.default_rng(1).normal(0, 0.1, 52), 3)
    linear = SC.linear_scorer([(-2 + k // 26, k % 26, float(w)) for k, w in enumerate(weights)])
    want = SC.scored_batch(recent, None, None, linear, 2, scaler).toPandas().set_index("symbol")
    assert (want.scaler_applied).all() and len(want) == 2
    newest = FT.features(bars, training=False).toPandas().sort_values("date").groupby("symbol").last()
    np.testing.assert_allclose(want[schemas.FEATURES].astype(float), newest.loc[want.index, schemas.FEATURES].astype(float), rtol=1e-6, atol=1e-6)
    # a model that MLlib has fitted to the same weights gives the same forecasts
    from pyspark.ml.functions import array_to_vector

    x = np.random.default_rng(2).random((200, 52))
    train = spark.createDataFrame([(r.tolist(), float(r @ weights)) for r in x], "x array<double>, label double").withColumn("vector", array_to_vector("x"))
    model = LinearRegression(featuresCol="vector").fit(train)
    fitted = SC.scored_batch(recent, None, None, lambda df: model.transform(df.withColumn("vector", array_to_vector(F.flatten("sequence")))).drop("vector"), 2, scaler)
    np.testing.assert_allclose(fitted.toPandas().set_index("symbol").predicted_price[want.index], want.predicted_price, rtol=1e-6)


def test_publication_is_seen_whole_or_not(spark, monkeypatch):
    path = scratch_path(spark, "champion")
    bars = spark.createDataFrame(history(sizes=(("A", 220, 2), ("B", 220, 2))), schemas.BARS)
    table = FT.features(bars)
    made = []
    keep = M.written
    monkeypatch.setattr(M, "written", lambda df, name: made.append(name) or keep(df, name))
    trials = [{"model_type": "gbt", "n_estimators": n, "max_depth": "2", "sequence_length": "3"} for n in ("1", "2")]
    results, models = M.run_trials(table, trials)
    assert made.count("samples") == 1  # one write for both trials
    scaler = Q.minmax_fit(table, [*schemas.FEATURES, schemas.TARGET])
    assert M.published(spark, path) is None
    M.publish(results, models, scaler, path)
    first = M.published(spark, path)
    with monkeypatch.context() as m:
        m.setattr(versions, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            M.publish(results.withColumn("rmse", -F.col("rmse")), models, scaler, path)
    again = M.published(spark, path)
    assert again.folder == first.folder and again.champions.count() == 2 and again.scaler.count() == 2
    model = again.model(again.champions.first()["trial_id"])
    assert len(SC.predict_batch(bars, None, None, M.mllib_scorer(model), 3, again.scaler).collect()) == 2


def test_search_holds_out_the_last_rows(spark):
    rows = [(s, START + dt.timedelta(days=i), float(i % 7), float(i % 7) / 10) for s, n in (("A", 300), ("B", 150), ("C", 40)) for i in range(n)]
    table = spark.createDataFrame(rows, "symbol string, date date, x double, y double")
    trials = [{"model_type": "random_forest", "n_estimators": "2", "max_depth": d} for d in ("1", "5")]
    found = M.cv_search(table, trials, 4, ["x"], "y")
    assert found.best == 2 and found.scores.count() == 8
    holdout = {r["symbol"]: r for r in found.holdout.collect()}
    assert {s: r["n"] for s, r in holdout.items()} == {"A": 90, "B": 90, "C": 40} and holdout["A"]["mae"] < 0.02
    for split in range(1, 5):
        before, test = M.fold(split, 4)
        ends = found.rows.filter("symbol = 'A'").agg(F.max(F.when(before, F.col("at"))), F.min(F.when(test, F.col("at"))), F.max(F.when(test, F.col("at")))).first()
        assert tuple(ends) == (42 * split + 0 - 1, 42 * split, 42 * split + 41)  # 210 rows inside, tests of 42


# Streams


def test_newest_logs_are_bounded_state(spark):
    path = scratch_path(spark, "newest")
    opened = []
    for batch in range(12):
        rows = [(s, f"2026-01-{batch + 1:02}T00:00:0{k}", "v", {"x": float(batch)}, None) for s in "AB" for k in range(3)]
        state = jobs.newest_state(spark.createDataFrame(rows, schemas.PREDICTION_LOG), path, batch, 7)
        if batch == 5:  # the batch runs again
            state = jobs.newest_state(spark.createDataFrame(rows, schemas.PREDICTION_LOG), path, batch, 7)
        opened.append(sum(len(spark.read.parquet(f"{path}/{jobs.BATCH}={b}").inputFiles()) for b in (batch - 1, batch) if b >= 0))
    assert sorted(map(tuple, state.groupBy("symbol").count().collect())) == [("A", 7), ("B", 7)]
    assert {r["timestamp"][:10] for r in state.collect()} == {"2026-01-10", "2026-01-11", "2026-01-12"}
    assert max(opened[6:]) <= max(opened[1:6])


def test_upsert_folds_its_batches(spark):
    path = scratch_path(spark, "folded")
    for k in range(7):
        day = START + dt.timedelta(days=k % 4)
        spark.createDataFrame([("A", day, *[float(k)] * 4, k)], schemas.BARS).coalesce(1).write.mode("append").parquet(f"{path}/inbox")
    stream = jobs.delivered(jobs.file_stream(spark, f"{path}/inbox", schemas.BARS, files_per_trigger=1))
    jobs.upsert_history(stream, f"{path}/table", f"{path}/checkpoint", every=3)
    assert versions.current(spark, jobs.bases(f"{path}/table"), jobs.BASE).startswith(f"{5:020d}")
    table = jobs.read_versions(spark, f"{path}/table", schemas.BARS, ["symbol", "date"])
    assert sorted(r["volume"] for r in table.collect()) == [3, 4, 5, 6]
    whole = jobs._since_base(spark, f"{path}/table", schemas.BARS)
    after = whole._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in after and len(whole.filter(f"{jobs.BATCH} > 5").collect()) == 1


# Sketches


def test_sketches_stay_within_their_error(spark):
    n = 200_000
    rows = spark.range(n).select(F.lit("A").alias("symbol"), (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1000.0).alias("x"), (F.col("id") % 7).alias("batch"))
    whole = SK.sketched(rows, ["symbol"], "x")
    path = scratch_path(spark, "sketches")
    for b in range(7):
        SK.append_sketches(SK.sketched(rows.filter(F.col("batch") == b), ["symbol"], "x"), path, f"b{b}")
    merged = SK.read_sketches(spark, path, whole, ["symbol"])
    shares = {f"q{i}": i / 20 for i in range(1, 20)}
    values = np.sort(rows.toPandas().x.to_numpy())
    for sketch in (whole, merged):
        row = SK.quantiles(sketch, shares).first()
        assert row["n"] == n and len(row["sketch"]) < 400_000
        for name, share in shares.items():
            assert abs(np.searchsorted(values, row[name], "right") / n - share) <= 2 * SK.rank_error()


@pytest.mark.parametrize("shift", [0.0, 0.02, 3.0])
def test_sketch_drift_is_near_the_exact_one(spark, shift):
    side = lambda n, seed, d: spark.range(n).select(F.lit("A").alias("symbol"), (F.randn(seed) + d).alias("x"))
    ref, cur = side(60_000, 1, 0.0), side(30_000, 2, shift)
    long = D.long_sides(ref, cur)
    ordered = D.ordered_sides(long)
    sketches = [SK.sketched(long.filter(F.col("side") == s), D.KEYS, "value") for s in ("reference", "current")]
    exact = D.ks(ordered).first()["statistic"]
    assert abs(SK.ks(*sketches).first()["statistic"] - exact) <= SK.gap_error()
    for method, error in (("wasserstein", 0.01), ("psi", 0.01)):
        want = D.judge(long, ordered, method).first()["statistic"]
        assert abs(SK.drift(*sketches, method).first()["statistic"] - want) <= error + 0.03 * want


# The classifier slot


def test_a_failing_classifier_loses_single_headlines_only(spark):
    calls = []

    def classify(texts):
        calls.append(len(texts))
        if texts.str.contains("bad").any():
            raise RuntimeError("no answer")
        return texts.map(lambda t: [{"label": "positive", "score": 1.0}])

    headlines = [(f"h{k} {'bad' if k in (3, 17) else 'good'}",) for k in range(40)] + [(None,)]
    out = spark.createDataFrame(headlines, "h string").select("h", N.tolerant_scorer(classify)("h").alias("a")).collect()
    assert [r["h"] for r in out if r["a"]["failed"]] == ["h3 bad", "h17 bad"]
    assert all((r["a"]["scores"] is not None) == ("good" in (r["h"] or "")) for r in out)


def test_scoring_job_computes_features_once(spark, sf, monkeypatch):
    """The scaler and both runs of a job read one written table, so macro and news data are joined once."""
    from tickloom.plans import QUERIES

    made = []
    features = FT.features
    monkeypatch.setattr(FT, "features", lambda *a, **b: made.append(a) or features(*a, **b))
    assert QUERIES["batch_predict_log"](spark, sf).count() > 0 and len(made) == 1
