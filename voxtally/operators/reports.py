"""The queries that consumers run on the output tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def sentiment_histogram(df: DataFrame, width: float = 0.25,
                        score: str = "sentiment_score") -> DataFrame:
    """Responses per score bucket ``[bucket, bucket + width)``."""
    bucket = F.floor(F.col(score) / width) * width
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def response_detail(df: DataFrame, question_id: int | None = None,
                    label: str | None = None) -> DataFrame:
    if question_id is not None:
        df = df.filter(F.col("question_id") == question_id)
    return df.filter(F.col("sentiment_label") == label) if label is not None else df


def length_vs_sentiment(df: DataFrame, key: str = "response_id") -> DataFrame:
    return df.select(key, "word_count", "sentiment_score")


def questions_by_sentiment(stats: DataFrame) -> DataFrame:
    """Questions ranked by mean sentiment, best first (equal means share a rank).

    Ranks come from the distinct means, of which rounding leaves at most 201.
    """
    counts = stats.groupBy("avg_sentiment_score").agg(F.count("*").alias("_n"))
    order = W.orderBy(F.desc("avg_sentiment_score"))
    above = F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select("avg_sentiment_score", (above + 1).alias("rank"))
    return stats.join(F.broadcast(ranks), "avg_sentiment_score").select(
        "question_id", "question_text_original", "avg_sentiment_score", "rank")


def top_questions(stats: DataFrame, k: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("total_responses"), "question_id").limit(k).select(
        "question_id", "question_text_original", "total_responses")


def keyword_min_frequency(totals: DataFrame, minimum: int) -> DataFrame:
    """Keywords over all questions with at least ``minimum`` occurrences."""
    return totals.groupBy("keyword").agg(
        F.sum("frequency").alias("frequency"), F.count("*").alias("questions")).filter(
        F.col("frequency") >= minimum)


def filter_responses(df: DataFrame, sheet: str | None = None, keyword: str | None = None,
                     topic: str | None = None, question_contains: str | None = None) -> DataFrame:
    """Responses of a sheet, with a keyword or topic, or by words of the question."""
    if sheet is not None:
        df = df.filter(F.col("sheet_name") == sheet)
    if keyword is not None:
        df = df.filter(F.exists("keywords", lambda x: x["keyword"] == keyword))
    if topic is not None:
        df = df.filter(F.array_contains("topics", topic))
    if question_contains is not None:
        df = df.filter(F.contains(F.lower("question_text_original"), F.lit(question_contains.lower())))
    return df


def responses_over_time(df: DataFrame, ts: str, width: str = "1 day") -> DataFrame:
    """Responses per time window."""
    return df.groupBy(F.window(ts, width).alias("w")).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), "n")


def responses_join_summary(responses: DataFrame, summary: DataFrame) -> DataFrame:
    """Responses with the figures of their question."""
    return responses.join(summary, "question_id")
