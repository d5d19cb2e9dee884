"""News sentiment: scored headlines to a daily score per symbol."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalar import epoch_local_date, polarity
from tickloom.operators.bars import FULL_NEWS_DAYS
from tickloom.operators.upsert import upsert_keep_last

ZONE = "America/Sao_Paulo"
SCORES_TYPE = "array<struct<label:string,score:double>>"


def scorer(classify: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """Make an Arrow-batched column function from a classifier of headline batches; no classifier is shipped."""
    return F.pandas_udf(classify, SCORES_TYPE)


def tolerant_scorer(classify: Callable[[pd.Series], pd.Series], attempts: int = 2) -> Callable[[Column], Column]:
    """The same for a classifier that can fail: a struct of ``scores`` and ``failed`` for each headline.

    A batch that fails ``attempts`` times is cut in halves, down to the headlines that fail by themselves; only these are
    without scores. So the result does not depend on how Spark cuts the batches. A null is not asked and has not failed.
    """

    def answered(headlines: pd.Series) -> list[tuple[list | None, bool]]:
        for _ in range(attempts):
            try:
                scores = list(classify(headlines.reset_index(drop=True)))
                if len(scores) != len(headlines):
                    raise ValueError("one answer for each headline expected")
                return [(s, False) for s in scores]
            except Exception:  # noqa: BLE001 - whatever the classifier raises, the job goes on
                continue
        if len(headlines) == 1:
            return [(None, True)]
        half = len(headlines) // 2
        return answered(headlines.iloc[:half]) + answered(headlines.iloc[half:])

    def batch(headlines: pd.Series) -> pd.DataFrame:
        known = headlines.notna().to_numpy()
        answers = iter(answered(headlines[known]) if known.any() else [])
        rows = [next(answers) if k else (None, False) for k in known]
        return pd.DataFrame({"scores": [s for s, _ in rows], "failed": [f for _, f in rows]})

    return F.pandas_udf(batch, f"struct<scores:{SCORES_TYPE},failed:boolean>")


def daily_classified(news: DataFrame, classify: Callable[[pd.Series], pd.Series], zone: str = ZONE) -> DataFrame:
    """Per symbol and day: headlines asked, those that failed (they count as 0), and the mean polarity."""
    asked = news.filter(F.coalesce(F.col("headline"), F.lit("")) != "")
    answers = asked.select("symbol", epoch_local_date("published", zone).alias("date"), tolerant_scorer(classify)(F.col("headline")).alias("_a"))
    scores = answers.select("symbol", "date", F.col("_a.failed").alias("failed"), polarity("_a.scores").alias("sentiment_score"))
    return scores.groupBy("symbol", "date").agg(
        F.count("*").alias("headlines"), F.count_if("failed").alias("failed"), F.avg("sentiment_score").alias("sentiment_score")
    )


def scored(news: DataFrame, zone: str = ZONE) -> DataFrame:
    """One polarity per headline that is not empty, on its local date."""
    return news.filter(F.coalesce(F.col("headline"), F.lit("")) != "").select(
        "symbol", epoch_local_date("published", zone).alias("date"), "headline", polarity("scores").alias("sentiment_score")
    )


def daily_sentiment(scores: DataFrame) -> DataFrame:
    return scores.groupBy("symbol", "date").agg(F.avg("sentiment_score").alias("sentiment_score"))


def lookback_days(history: DataFrame, symbols: DataFrame, as_of: dt.date, default: int = FULL_NEWS_DAYS) -> DataFrame:
    """Days of news to load per symbol: since its first bar, or ``default`` without history."""
    first = history.groupBy("symbol").agg(F.min("date").alias("_first"))
    return symbols.select("symbol").join(first, "symbol", "left").select(
        "symbol", F.coalesce(F.datediff(F.lit(as_of), "_first"), F.lit(default)).alias("days")
    )


def sentiment_job(news: DataFrame, old: DataFrame, as_of: dt.date, days: int | None = None) -> DataFrame:
    """Score, average per day and merge into the old table, optionally for the last ``days`` only."""
    scores = scored(news)
    if days is not None:
        scores = scores.filter(F.col("date").between(F.date_sub(F.lit(as_of), days), F.lit(as_of)))
    return upsert_keep_last(old, daily_sentiment(scores))


def source_has_dates(bars: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Per symbol, whether any sentiment date matches a bar."""
    hits = bars.join(sentiment.select("symbol", "date"), ["symbol", "date"], "left_semi").select("symbol").distinct()
    return (
        bars.select("symbol").distinct().join(hits.withColumn("_hit", F.lit(True)), "symbol", "left")
        .select("symbol", F.coalesce("_hit", F.lit(False)).alias("has_sentiment"))
    )
