"""Time the headline queries (all with BENCH_ALL=1) and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickloom.plans import QUERIES  # noqa: E402
from tickloom.session import local_session  # noqa: E402

HEADLINE = [
    "features_full", "features_inference_mode", "features_base", "features_eda", "batch_predict", "bars_from_ticks",
    "join_macro", "join_sentiment", "sma", "bollinger", "ema", "rsi_14", "macd", "obv", "drawdown", "ffill",
    "resample_daily_ffill", "seasonal_decompose", "acf_40", "pacf_40", "corr_matrix_features", "return_stats",
    "volume_clip_q99", "history_upsert", "news_sentiment_job", "latest_logs_100", "sequences", "minmax_scale",
    "ts_folds", "drift_ks", "drift_wasserstein", "drift_psi", "drift_report", "stream_daily_bars", "train_gbt",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    QUERIES["log_return"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
