"""Queries that read, write, clean, join and merge tables."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import scalar as X
from tickloom.operators import bars as B
from tickloom.operators import columns as C
from tickloom.operators import features as FT
from tickloom.operators import news as N
from tickloom.operators import selection as L
from tickloom.operators.upsert import union, upsert_keep_last
from tickloom.plans import sql as S
from tickloom.plans.feature_tables import ALL, DIGITS, digits, inputs, sql_columns
from tickloom.plans.registry import query, show
from tickloom.plans.sql import r
from tickloom.plans.windows import BARS
from tickloom.schemas import BARS as BARS_SCHEMA
from tickloom.schemas import FEATURE_TABLE, FEATURES, TARGET
from tickloom.session import scratch_path
from tickloom.sources import logs as LG
from tickloom.sources import views
from tickloom.sources.files import read_csv_loose, read_json_document, read_table, scan_bars, typed, write_table

AS_OF = dt.date(1998, 6, 30)
CLOSES = ["SP500_Close", "VIX_Close", "EURUSD_Close"]
BAR_COLUMNS = "symbol, date, open, high, low, close, volume"


# Sources and sinks


def landed(df: DataFrame, name: str, fmt: str, partition_by: tuple[str, ...] = ()) -> str:
    path = scratch_path(df.sparkSession, name)
    write_table(df, path, fmt, partition_by)
    return path


@query("scan_csv", f"{BARS} SELECT symbol, count(*) AS n, sum(close) AS total, min(date) AS first_date FROM (SELECT symbol, date, round(close) AS close FROM bars) GROUP BY symbol")
def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = landed(views.bars(spark, sf), "csv", "csv")
    b = read_table(spark, path, BARS_SCHEMA, "csv")
    absent = read_table(spark, f"{path}-absent", BARS_SCHEMA, "csv")
    return b.unionByName(absent).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round("close")).alias("total"), F.min("date").alias("first_date")
    )


@query("sink_csv_roundtrip", f"{BARS} SELECT {BAR_COLUMNS} FROM bars")
def sink_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, landed(views.bars(spark, sf), "csv", "csv"), BARS_SCHEMA, "csv")


@query("scan_json", f"{BARS} SELECT symbol, max(date) AS last_date FROM bars GROUP BY symbol")
def scan_json(spark: SparkSession, sf: str) -> DataFrame:
    """Pointers as a table of JSON lines and as one pretty-printed document per symbol; both must say the same."""
    pointers = views.bars(spark, sf).groupBy("symbol").agg(F.max("date").alias("last_date"))
    path = landed(pointers, "json", "json")
    lines = read_table(spark, path, pointers.schema, "json")
    documents = lines.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"), F.col("symbol").alias("folder"))
    documents.write.partitionBy("folder").text(f"{path}-documents")  # a file for each symbol
    read = read_json_document(spark, f"{path}-documents", pointers.schema)
    return lines.join(read.select("symbol", "last_date"), ["symbol", "last_date"])


@query("sink_json_roundtrip", f"{BARS} SELECT {BAR_COLUMNS} FROM bars")
def sink_json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, landed(views.bars(spark, sf), "json", "json"), BARS_SCHEMA, "json")


@query("scan_bars_since", f"{BARS} SELECT {BAR_COLUMNS} FROM bars WHERE date >= DATE '1998-06-30'")
def scan_bars_since(spark: SparkSession, sf: str) -> DataFrame:
    return scan_bars(spark, landed(views.bars(spark, sf), "bars", "parquet"), BARS_SCHEMA, since=AS_OF)


@query(
    "scan_macro_range",
    f"WITH {S.MACRO} SELECT date, series, {r('close', 6)} AS close FROM macro WHERE date >= DATE '1996-01-01' AND date < DATE '1996-12-31' + INTERVAL 5 DAY",
)
def scan_macro_range(spark: SparkSession, sf: str) -> DataFrame:
    out = B.macro_range(views.macro_long(spark, sf), dt.date(1996, 1, 1), dt.date(1996, 12, 31))
    return show(out, "date", "series", close=6)


@query(
    "macro_lookback_200d",
    f"WITH {S.MACRO} SELECT date, series, {r('close', 6)} AS close FROM macro WHERE date >= DATE '1998-06-30' - INTERVAL 200 DAY AND date < DATE '1998-06-30' + INTERVAL 5 DAY",
)
def macro_lookback_200d(spark: SparkSession, sf: str) -> DataFrame:
    return show(B.macro_lookback(views.macro_long(spark, sf), AS_OF), "date", "series", close=6)


@query(
    "bars_from_ticks",
    "SELECT event_type AS symbol, CAST(ts AS DATE) AS date, min_by(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, "
    "max_by(value, (ts, event_id)) AS close, CAST(sum(event_id % 7 + 1) AS BIGINT) AS volume FROM events GROUP BY ALL",
)
def bars_from_ticks(spark: SparkSession, sf: str) -> DataFrame:
    ticks = views.table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), "ts", "value", "event_id", (F.col("event_id") % 7 + 1).alias("quantity")
    )
    return B.bars_from_ticks(ticks, ts="ts", price="value", tie="event_id", every=F.to_date("ts"))


def event_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Log records from the events: features value and k; a missing block where k is a multiple of 10."""
    logs = views.feature_logs(spark, sf).withColumn(
        "prediction_output",
        F.struct(
            "symbol",
            F.col("value").alias("current_price"),
            (F.col("value") * 1.01).alias("predicted_price_tomorrow"),
            F.lit(1.0).alias("variation_pct"),
            F.date_format("ts", "yyyy-MM-dd").alias("timestamp"),
            F.lit(None).cast("string").alias("message"),
        ),
    )
    built = LG.build_log(logs, ["value", "k"])
    has_block = F.col("features_input")["k"] % 10 != 0
    return built.withColumn("features_input", F.when(has_block, F.col("features_input")))


TS = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"


@query(
    "prediction_log_build",
    f"WITH {S.LOGS} SELECT symbol, {TS} AS timestamp, 'champion' AS model_version, value, k, "
    "'predictions/' || symbol || '/' || strftime(ts, '%Y-%m-%dT%H-%M-%S-%f') || '.json' AS log_key FROM logs",
)
def prediction_log_build(spark: SparkSession, sf: str) -> DataFrame:
    logs = views.feature_logs(spark, sf).withColumn("prediction_output", F.struct(F.col("value").alias("current_price")))
    built = LG.build_log(logs, ["value", "k"])
    return built.select(
        "symbol",
        "timestamp",
        "model_version",
        F.col("features_input")["value"].alias("value"),
        F.col("features_input")["k"].alias("k"),
        LG.log_key(F.col("symbol"), F.col("timestamp").cast("timestamp_ntz")).alias("log_key"),
    )


@query(
    "latest_logs_100",
    f"WITH {S.LOGS} SELECT symbol, {TS} AS timestamp, value, k FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS i "
    "FROM logs WHERE k % 10 <> 0) WHERE i <= 100",
)
def latest_logs_100(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "logs")
    LG.write_logs(event_logs(spark, sf), path)
    new = LG.newest(LG.read_logs(spark, path), [F.col("timestamp").desc(), F.col("mtime").desc()])
    return LG.flatten_features(new, ["value", "k"], keep=("symbol", "timestamp"))


@query("log_features_flatten", f"WITH {S.LOGS} SELECT symbol, value, k FROM logs WHERE k % 10 <> 0")
def log_features_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return LG.flatten_features(event_logs(spark, sf), ["value", "k"])


@query(
    "predictions_today",
    f"WITH {S.LOGS} SELECT symbol, CAST(ts AS DATE) AS date, count(*) AS predictions FROM logs GROUP BY ALL",
)
def predictions_today(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date(F.substring("timestamp", 1, 10)).alias("date")
    return event_logs(spark, sf).groupBy("symbol", day).agg(F.count(F.lit(1)).alias("predictions"))


@query("load_clean_features", f"WITH {S.TECHNICAL_CTES} SELECT symbol, date, {sql_columns(['Log_Return', 'Lag_1', TARGET])} FROM feat WHERE Lag_5 IS NOT NULL")
def load_clean_features(spark: SparkSession, sf: str) -> DataFrame:
    raw = FT.raw_features(views.bars(spark, sf), groups=("base",)).filter("Lag_5 IS NOT NULL")
    stray = raw.select(F.lit(0).alias("Unnamed: 0"), "symbol", "date", "Log_Return", "Lag_1", TARGET)
    back = typed(read_csv_loose(spark, landed(stray, "clean", "csv")), FEATURE_TABLE)
    return show(back, "symbol", "date", **digits(["Log_Return", "Lag_1", TARGET]))


@query(
    "historical_clean",
    f"WITH {S.FEATURE_CTES} SELECT symbol, date, {sql_columns(FEATURES)} FROM feat WHERE {S.complete(FEATURES)}",
)
def historical_clean(spark: SparkSession, sf: str) -> DataFrame:
    b, returns, sentiment = inputs(spark, sf)
    history = read_table(spark, landed(b, "history", "csv"), BARS_SCHEMA, "csv")
    clean = FT.features(history, returns, sentiment, training=False)
    path = landed(clean, "processed", "parquet", ("symbol",))
    return show(read_table(spark, path, FEATURE_TABLE), "symbol", "date", **digits(FEATURES))


TRAINING_MACRO = S.MACRO_RETURNS.replace(
    "FROM macro GROUP BY date",
    "FROM macro WHERE date >= (SELECT min(date) FROM bars) AND date < (SELECT max(date) FROM bars) + INTERVAL 5 DAY GROUP BY date",
)


@query(
    "training_set",
    f"WITH {S.BARS}, {TRAINING_MACRO}, {S.SENTIMENT}, {S.features()} SELECT symbol, date, {sql_columns(ALL)} FROM feat WHERE {S.complete(ALL)}",
)
def training_set(spark: SparkSession, sf: str) -> DataFrame:
    b = views.bars(spark, sf)
    sentiment = N.daily_sentiment(N.scored(views.news(spark, sf)))
    out = FT.training_set(b, views.macro_long(spark, sf), sentiment)
    path = landed(out, "training", "csv")
    return show(read_table(spark, path, out.schema, "csv"), "symbol", "date", **digits(ALL))


# Projections and column handling


@query("project_ohlcv", f"{BARS} SELECT {BAR_COLUMNS} FROM bars")
def project_ohlcv(spark: SparkSession, sf: str) -> DataFrame:
    full = views.bars(spark, sf).withColumns({"dividends": F.lit(0.0), "stock_splits": F.lit(0.0)})
    return B.project(full)


@query("tz_drop", "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date FROM orders")
def tz_drop(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), X.drop_zone("o_orderdate").alias("date"))


@query(
    "macro_pivot",
    f"WITH {S.MACRO_WIDE} SELECT date, " + ", ".join(f"{r(c, 6)} AS {c}" for c in CLOSES) + " FROM macro_wide",
)
def macro_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return show(B.macro_wide(views.macro_long(spark, sf)), "date", **dict.fromkeys(CLOSES, 6))


@query("rename_existing", f"{BARS} SELECT symbol, date, close AS SP500_Close FROM bars")
def rename_existing(spark: SparkSession, sf: str) -> DataFrame:
    raw = views.bars(spark, sf).select("symbol", "date", F.col("close").alias("^GSPC"))
    return C.rename_existing(raw, {"^GSPC": "SP500_Close", "^VIX": "VIX_Close", "EURUSD=X": "EURUSD_Close"})


@query("drop_existing", f"{BARS} SELECT symbol, date, close FROM bars")
def drop_existing(spark: SparkSession, sf: str) -> DataFrame:
    return C.drop_existing(views.bars(spark, sf), ["open", "high", "low", "Adj Close", "volume", "Dividends", "Stock Splits"])


@query("align_columns_zero", f"{BARS} SELECT symbol, date, close, CAST(0 AS DOUBLE) AS SP500_Return, high FROM bars")
def align_columns_zero(spark: SparkSession, sf: str) -> DataFrame:
    return C.align_zero(views.bars(spark, sf), ["close", "SP500_Return", "high"])


@query(
    "align_columns_ref_mean",
    f"WITH {S.LOGS}, m AS (SELECT symbol, avg(k) AS k FROM logs WHERE side = 'reference' GROUP BY symbol) "
    f"SELECT l.symbol, l.value, {r('m.k', 6)} AS k FROM logs l JOIN m USING (symbol) WHERE side = 'current'",
)
def align_columns_ref_mean(spark: SparkSession, sf: str) -> DataFrame:
    reference, current = views.log_halves(spark, sf)
    return show(C.align_reference_mean(current.drop("k"), reference, ["value", "k"]), "symbol", "value", k=6)


@query(
    "scrub_nonfinite",
    f"SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_discount = 0 OR l_tax = 0 THEN 0 ELSE {r('l_tax / l_discount', 6)} END AS x, "
    "CASE WHEN l_tax = 0 THEN 0 ELSE l_tax END AS y FROM lineitem",
)
def scrub_nonfinite(spark: SparkSession, sf: str) -> DataFrame:
    tax, discount = F.col("l_tax"), F.col("l_discount")
    raw = views.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        F.when(discount == 0, F.lit(float("inf"))).when(tax == 0, F.lit(float("nan"))).otherwise(X.ratio(tax, discount)).alias("x"),
        F.when(tax != 0, tax).alias("y"),
    )
    return show(C.scrub(raw, ["x", "y"]), "id", "line", "y", x=6)


RAW_TICKERS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN ' ' || lower(o_orderpriority) || ' ' ELSE o_orderpriority || o_orderstatus END AS raw FROM orders"


def tickers(spark: SparkSession, sf: str) -> DataFrame:
    raw = (
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" "), F.lower("o_orderpriority"), F.lit(" ")))
        .otherwise(F.concat("o_orderpriority", "o_orderstatus"))
    )
    return views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), X.ticker(raw).alias("symbol"))


TICKERS_SQL = f"WITH raw AS ({RAW_TICKERS}), t AS (SELECT id, upper(trim(raw)) AS symbol FROM raw), ok AS (SELECT DISTINCT o_orderpriority AS symbol FROM orders)"


@query("symbol_allowlist", f"{TICKERS_SQL} SELECT id, symbol FROM t WHERE symbol IN (SELECT symbol FROM ok)")
def symbol_allowlist(spark: SparkSession, sf: str) -> DataFrame:
    known = views.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol")).distinct()
    return C.allowed(tickers(spark, sf), known).select("id", "symbol")


@query("symbol_rejects", f"{TICKERS_SQL} SELECT id, symbol FROM t WHERE symbol NOT IN (SELECT symbol FROM ok)")
def symbol_rejects(spark: SparkSession, sf: str) -> DataFrame:
    known = views.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol")).distinct()
    return C.rejected(tickers(spark, sf), known).select("id", "symbol")


@query(
    "string_norm",
    "SELECT s_suppkey AS id, upper(trim('  ' || lower(s_name) || ' ')) AS ticker, starts_with(s_name, 'Supplier#0000') AS is_stray, "
    "ends_with(lower(s_name), '7') AS is_seven FROM supplier",
)
def string_norm(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("s_name")
    return views.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"),
        X.ticker(F.concat(F.lit("  "), F.lower(name), F.lit(" "))).alias("ticker"),
        name.startswith("Supplier#0000").alias("is_stray"),
        F.lower(name).endswith("7").alias("is_seven"),
    )


@query(
    "date_math",
    "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) + 1 AS next_day, CAST(o_orderdate AS DATE) + 5 AS padded, CAST(o_orderdate AS DATE) - 200 AS lookback, "
    "CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-06-30') AS INTEGER) AS days_ago, strftime(o_orderdate, '%Y-%m-%d') AS text, "
    "CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start FROM orders",
)
def date_math(spark: SparkSession, sf: str) -> DataFrame:
    d = X.drop_zone("o_orderdate")
    return views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.date_add(d, 1).alias("next_day"),
        F.date_add(d, 5).alias("padded"),
        F.date_sub(d, 200).alias("lookback"),
        F.datediff(F.lit(AS_OF), d).alias("days_ago"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("text"),
        F.trunc(d, "month").alias("month_start"),
    )


@query(
    "epoch_to_local_date",
    "SELECT event_id, CAST(to_timestamp(epoch(ts)) AT TIME ZONE 'America/Sao_Paulo' AS DATE) AS local_date FROM events",
)
def epoch_to_local_date(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.unix_seconds(X.utc_instant("ts"))
    return views.table(spark, sf, "events").select("event_id", X.epoch_local_date(seconds).alias("local_date"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS built FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    parsed = F.from_json("props", "k BIGINT")
    return views.table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), F.to_json(parsed).alias("built"))


# Joins


@query(
    "join_macro",
    f"WITH {S.BARS}, {S.MACRO_RETURNS} SELECT b.symbol, b.date, close, "
    + ", ".join(f"{r(f'coalesce({c}, 0)', 6)} AS {c}" for c in ("SP500_Return", "VIX_Return", "EURUSD_Return"))
    + " FROM bars b LEFT JOIN macro_returns m ON b.date = m.date",
)
def join_macro(spark: SparkSession, sf: str) -> DataFrame:
    out = B.join_macro(views.bars(spark, sf), B.macro_returns(views.macro_long(spark, sf)))
    return show(out, "symbol", "date", "close", SP500_Return=6, VIX_Return=6, EURUSD_Return=6)


@query(
    "join_sentiment",
    f"WITH {S.BARS}, {S.SENTIMENT} SELECT b.symbol, b.date, close, {r('coalesce(sentiment_score, 0)', 6)} AS Sentiment_Score "
    "FROM bars b LEFT JOIN sentiment s ON b.symbol = s.symbol AND b.date = s.date",
)
def join_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    out = B.join_sentiment(views.bars(spark, sf), N.daily_sentiment(N.scored(views.news(spark, sf))))
    return show(out, "symbol", "date", "close", Sentiment_Score=6)


@query(
    "sentiment_source_probe",
    f"WITH {S.BARS}, {S.SENTIMENT}, other AS (SELECT symbol, date FROM sentiment WHERE symbol <> '5-LOW' UNION ALL SELECT symbol, date + 20000 FROM sentiment WHERE symbol = '5-LOW') "
    "SELECT b.symbol, max(o.date IS NOT NULL) AS has_sentiment FROM bars b LEFT JOIN other o ON b.symbol = o.symbol AND b.date = o.date GROUP BY b.symbol",
)
def sentiment_source_probe(spark: SparkSession, sf: str) -> DataFrame:
    s = N.daily_sentiment(N.scored(views.news(spark, sf)))
    late = s.withColumn("date", F.when(F.col("symbol") == "5-LOW", F.date_add("date", 20000)).otherwise(F.col("date")))
    return N.source_has_dates(views.bars(spark, sf), late)


# News


@query("news_polarity", f"WITH {S.SCORED} SELECT symbol, date, {r('score', 6)} AS polarity FROM scored")
def news_polarity(spark: SparkSession, sf: str) -> DataFrame:
    out = N.scored(views.news(spark, sf)).withColumnRenamed("sentiment_score", "polarity")
    return show(out, "symbol", "date", polarity=6)


@query("daily_sentiment", f"WITH {S.SENTIMENT} SELECT symbol, date, {r('sentiment_score', 6)} AS sentiment_score FROM sentiment")
def daily_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return show(N.daily_sentiment(N.scored(views.news(spark, sf))), "symbol", "date", sentiment_score=6)


OLD_SENTIMENT = "old AS (SELECT symbol, date, close / 1000000 AS sentiment_score FROM bars)"


def old_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return views.bars(spark, sf).select("symbol", "date", (F.col("close") / 1000000).alias("sentiment_score"))


def merge_sql(extra: str = "") -> str:
    return (
        f"SELECT symbol, date, {r('coalesce(n.sentiment_score, o.sentiment_score)', 6)} AS sentiment_score "
        f"FROM old o FULL JOIN (SELECT * FROM sentiment {extra}) n USING (symbol, date)"
    )


@query("sentiment_upsert", f"WITH {S.BARS}, {S.SENTIMENT}, {OLD_SENTIMENT} {merge_sql()}")
def sentiment_upsert(spark: SparkSession, sf: str) -> DataFrame:
    new = N.daily_sentiment(N.scored(views.news(spark, sf)))
    return show(upsert_keep_last(old_sentiment(spark, sf), new), "symbol", "date", sentiment_score=6)


@query("sentiment_upsert_empty", f"WITH {S.BARS}, {OLD_SENTIMENT} SELECT symbol, date, {r('sentiment_score', 6)} AS sentiment_score FROM old")
def sentiment_upsert_empty(spark: SparkSession, sf: str) -> DataFrame:
    old = old_sentiment(spark, sf)
    nothing = views.news(spark, sf).withColumn("headline", F.lit(""))
    return show(N.sentiment_job(nothing, old, AS_OF), "symbol", "date", sentiment_score=6)


@query(
    "news_sentiment_job",
    f"WITH {S.BARS}, {S.SENTIMENT}, {OLD_SENTIMENT} {merge_sql(chr(87) + 'HERE date BETWEEN DATE ' + repr('1998-06-30') + ' - 360 AND DATE ' + repr('1998-06-30'))}",
)
def news_sentiment_job(spark: SparkSession, sf: str) -> DataFrame:
    out = N.sentiment_job(views.news(spark, sf), old_sentiment(spark, sf), AS_OF, days=360)
    return show(out, "symbol", "date", sentiment_score=6)


FAILS = 997


def by_number(headlines: pd.Series) -> pd.Series:
    """A classifier with known answers, by the number in a headline; it breaks down at some headlines, and with them a whole batch."""
    numbers = headlines.str.split().str[-1].astype("int64")
    if (numbers % FAILS == 0).any():
        raise RuntimeError("no answer")
    label = numbers.mod(3).map({0: "positive", 1: "negative", 2: "neutral"})
    return pd.Series([[{"label": w, "score": (n % 10) / 10}] for w, n in zip(label, numbers)])


@query(
    "news_classified",
    "WITH n AS (SELECT o_orderpriority AS symbol, CAST(l_shipdate AS DATE) AS date, l_orderkey AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 2) "
    f"SELECT symbol, date, count(*) AS headlines, CAST(count(CASE WHEN k % {FAILS} = 0 THEN 1 END) AS BIGINT) AS failed, "
    f"{r(f'avg(CASE WHEN k % {FAILS} = 0 OR k % 3 = 2 THEN 0 WHEN k % 3 = 0 THEN (k % 10) / 10 ELSE -(k % 10) / 10 END)', 6)} AS sentiment_score FROM n GROUP BY symbol, date",
)
def news_classified(spark: SparkSession, sf: str) -> DataFrame:
    """Headlines through the classifier slot: those without an answer count as 0, and are counted."""
    out = N.daily_classified(views.news(spark, sf).drop("scores"), by_number)
    return show(out, "symbol", "date", "headlines", "failed", sentiment_score=6)


# Merging and incremental loading

HALVES = (
    "old AS (SELECT * FROM bars WHERE date < DATE '2000-01-01'), "
    "new AS (SELECT symbol, date, open, high, low, close * 1.01 AS close, volume FROM bars WHERE date >= DATE '1999-12-01')"
)


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    b = views.bars(spark, sf)
    new = b.filter(F.col("date") >= dt.date(1999, 12, 1)).withColumn("close", F.col("close") * 1.01)
    return b.filter(F.col("date") < dt.date(2000, 1, 1)), new


@query("history_union", f"WITH {S.BARS}, {HALVES} SELECT symbol, date, {r('close', 4)} AS close FROM old UNION ALL SELECT symbol, date, {r('close', 4)} FROM new")
def history_union(spark: SparkSession, sf: str) -> DataFrame:
    return show(union(*halves(spark, sf)), "symbol", "date", close=4)


UPSERTED = "up AS (SELECT * FROM new UNION ALL SELECT * FROM old WHERE (symbol, date) NOT IN (SELECT (symbol, date) FROM new))"


@query("history_upsert", f"WITH {S.BARS}, {HALVES}, {UPSERTED} SELECT symbol, date, open, high, low, {r('close', 4)} AS close, volume FROM up")
def history_upsert(spark: SparkSession, sf: str) -> DataFrame:
    out = upsert_keep_last(*halves(spark, sf))
    return show(out, "symbol", "date", "open", "high", "low", "volume", close=4)


@query(
    "scoring_input",
    f"WITH {S.BARS}, {HALVES}, {UPSERTED} SELECT symbol, date, {r('close', 4)} AS close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS i FROM up) WHERE i <= 250",
)
def scoring_input(spark: SparkSession, sf: str) -> DataFrame:
    return show(L.tail(upsert_keep_last(*halves(spark, sf)), 250), "symbol", "date", close=4)


@query("tail_n", f"{BARS} SELECT symbol, date, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS i FROM bars) WHERE i <= 500")
def tail_n(spark: SparkSession, sf: str) -> DataFrame:
    return L.tail(views.bars(spark, sf), 500).select("symbol", "date", "close")


@query("last_quote", f"{BARS} SELECT symbol, max_by(close, date) AS last_price, max(date) AS last_date FROM bars GROUP BY symbol")
def last_quote(spark: SparkSession, sf: str) -> DataFrame:
    return L.last_quote(views.bars(spark, sf))


@query(
    "champion_model",
    "SELECT p_brand AS symbol, p_partkey AS trial_id, p_retailprice AS rmse FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS i FROM part) WHERE i = 1",
)
def champion_model(spark: SparkSession, sf: str) -> DataFrame:
    return L.champion(views.trials(spark, sf))


POINTER_SQL = (
    f"{BARS}, pointer AS (SELECT o_orderpriority AS symbol, max(CAST(o_orderdate AS DATE)) - CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 90 END AS last_date "
    "FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_orderpriority), "
    "starts AS (SELECT symbol, last_date, CASE WHEN last_date >= DATE '2001-07-31' THEN last_date ELSE last_date + 1 END AS start_date FROM pointer)"
)
TODAY = dt.date(2001, 7, 31)


def pointer(spark: SparkSession, sf: str) -> DataFrame:
    """A pointer per symbol; one symbol is up to date and one has none yet."""
    last = views.bars(spark, sf).groupBy("symbol").agg(F.max("date").alias("last")).filter("symbol <> '5-LOW'")
    back = F.when(F.col("symbol") == "1-URGENT", 0).otherwise(90)
    return last.select("symbol", F.date_sub("last", back).alias("last_date"))


@query("incremental_start", f"{POINTER_SQL} SELECT symbol, last_date, start_date FROM starts")
def incremental_start(spark: SparkSession, sf: str) -> DataFrame:
    return B.next_start(pointer(spark, sf), TODAY)


@query(
    "incremental_batch",
    f"{POINTER_SQL} SELECT b.symbol, b.date, b.close FROM bars b LEFT JOIN starts s USING (symbol) WHERE s.start_date IS NULL OR b.date >= s.start_date",
)
def incremental_batch(spark: SparkSession, sf: str) -> DataFrame:
    return B.bars_since(views.bars(spark, sf), pointer(spark, sf), TODAY).select("symbol", "date", "close")


@query(
    "pointer_update",
    f"{POINTER_SQL}, batch AS (SELECT symbol, max(date) AS new_date FROM bars WHERE symbol <> '2-HIGH' GROUP BY symbol) "
    "SELECT symbol, coalesce(new_date, last_date) AS last_date FROM pointer FULL JOIN batch USING (symbol)",
)
def pointer_update(spark: SparkSession, sf: str) -> DataFrame:
    batch = views.bars(spark, sf).filter("symbol <> '2-HIGH'")  # this symbol has no new bars
    return B.update_pointer(pointer(spark, sf), batch)


@query(
    "symbols_without_data",
    f"{BARS} SELECT DISTINCT c_mktsegment AS symbol FROM customer WHERE c_mktsegment NOT IN (SELECT symbol FROM bars)",
)
def symbols_without_data(spark: SparkSession, sf: str) -> DataFrame:
    b = views.bars(spark, sf).select("symbol")
    asked = b.union(views.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("symbol")))
    return L.symbols_without_data(asked, b)


assert set(FEATURES) <= set(DIGITS)
