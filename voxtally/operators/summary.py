"""Per-question and corpus aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import round_half_even
from ..session import stage
from .keyphrases import bag_rows

QUESTION = ("question_id", "question_text_original")
SUMMARY_COLUMNS = ("question_id", "question_text", "total_responses", "avg_response_length",
                   "avg_word_count", "avg_sentiment_score", "sentiment_std", "positive_responses",
                   "negative_responses", "neutral_responses", "survey_sources", "keyword",
                   "frequency")
INSTANCE_CHUNK = 10_000
POOL_ORDER = ("late", "first_seen", "pos")


def question_stats(df: DataFrame, keys: Sequence[str] = QUESTION) -> DataFrame:
    """Counts, rounded means and deviation, and label counts per question.

    A single aggregate with map-side combine; a single response has no deviation.
    """
    label = F.col("sentiment_label")
    return df.groupBy(*keys).agg(
        F.count("*").alias("total_responses"),
        round_half_even(F.avg("response_length")).alias("avg_response_length"),
        round_half_even(F.avg("word_count")).alias("avg_word_count"),
        round_half_even(F.avg("sentiment_score")).alias("avg_sentiment_score"),
        round_half_even(F.stddev_samp("sentiment_score")).alias("sentiment_std"),
        F.count_if(label == "positive").alias("positive_responses"),
        F.count_if(label == "negative").alias("negative_responses"),
        F.count_if(label == "neutral").alias("neutral_responses"),
    )


def survey_sources(df: DataFrame, keys: Sequence[str] = QUESTION, sheet: str = "sheet_name",
                   row_id: str = "response_id") -> DataFrame:
    """Distinct sheets per question in order of first appearance, comma-joined."""
    firsts = df.groupBy(*keys, sheet).agg(F.min(row_id).alias("_first"))
    ordered = F.array_sort(F.collect_list(F.struct("_first", F.col(sheet).alias("s"))))
    return firsts.groupBy(*keys).agg(F.array_join(
        F.transform(ordered, lambda x: x["s"]), ", ").alias("survey_sources"))


def keyword_totals(df: DataFrame, keys: Sequence[str], bag: str = "keywords",
                   row_id: str = "response_id") -> DataFrame:
    """Merged bags: keys, keyword, frequency and first sighting (for ties).

    The sighting is kept in two plain buffers, since the minimum of a struct
    would turn the hash aggregate into a sort.
    """
    rows = bag_rows(df, bag, *dict.fromkeys([*keys, row_id]))
    totals = rows.groupBy(*keys, "keyword").agg(
        F.sum("count").cast("long").alias("frequency"),
        F.min(row_id).alias("_row"), F.min_by("rank", row_id).alias("_rank"))
    return totals.select(*keys, "keyword", "frequency", F.struct("_row", "_rank").alias("first_seen"))


def top_keywords(totals: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    """The k most frequent per group, ties by first sighting.

    ``row_number() <= k`` prunes inside each input partition before the shuffle,
    so a group holding most keywords sends k rows per task.
    """
    order = W.partitionBy(*keys).orderBy(F.desc("frequency"), "first_seen")
    return totals.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def summary_by_question(df: DataFrame, bag: str = "keywords", k: int = 10) -> DataFrame:
    """One row per question and keyword; a question without any keeps one blank row."""
    keys = list(QUESTION)
    best = top_keywords(keyword_totals(df, keys, bag), keys, k)
    return (question_stats(df).join(survey_sources(df), keys)
            .join(best.select(*keys, "keyword", "frequency", "rank"), keys, "left")
            .withColumns({"keyword": F.coalesce("keyword", F.lit("")),
                          "frequency": F.coalesce("frequency", F.lit(0))})
            .orderBy("question_id", F.desc("frequency"), "rank")
            .withColumnRenamed("question_text_original", "question_text")
            .select(*SUMMARY_COLUMNS))


def keyword_pool(totals: DataFrame, vocabulary_freq: DataFrame) -> DataFrame:
    """All keywords with frequency, plus vocabulary words of the texts not among them.

    ``vocabulary_freq`` holds ``(keyword, doc_freq, pos)``; membership ignores case.
    The columns of ``POOL_ORDER`` break ties: keywords by first sighting, then
    vocabulary words in list order.
    """
    vocabulary = stage(vocabulary_freq.withColumn("_k", F.lower("keyword")))
    # at most as many rows as the vocabulary, whatever the number of keywords
    known = totals.select(F.lower("keyword").alias("_k")).join(
        vocabulary.select("_k"), "_k", "left_semi").distinct()
    extra = vocabulary.join(known, "_k", "left_anti")
    return totals.select("keyword", "frequency", F.lit(0).alias("late"), "first_seen",
                         F.lit(None).cast("long").alias("pos")).unionByName(
        extra.select("keyword", F.col("doc_freq").alias("frequency"), F.lit(1).alias("late"),
                     F.lit(None).cast(totals.schema["first_seen"].dataType).alias("first_seen"),
                     F.col("pos").cast("long").alias("pos")))


def instances(pool: DataFrame, *ties: Column | str, limit: int = 200) -> DataFrame:
    """The ``limit`` most frequent keywords, each repeated ``frequency`` times.

    Repeats are made in chunks spread over tasks, so one huge frequency neither
    builds one huge array nor stays in one task.
    """
    top = pool.orderBy(F.desc("frequency"), *ties).limit(limit)
    chunks = top.filter("frequency > 0").select("keyword", "frequency", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("frequency") - 1) / INSTANCE_CHUNK))).alias("c"))
    size = F.least(F.lit(INSTANCE_CHUNK), F.col("frequency") - F.col("c") * INSTANCE_CHUNK)
    return chunks.repartition("keyword", "c").select(
        F.explode(F.array_repeat("keyword", size.cast("int"))).alias("keyword"))


def meaningful_questions(df: DataFrame, key: str = "question_id", length: str = "response_length",
                         minimum: float = 10) -> DataFrame:
    """Responses of questions whose mean answer is longer than ``minimum``."""
    kept = df.groupBy(key).agg(F.avg(length).alias("_mean")).filter(
        F.col("_mean") > minimum).select(key)
    return df.join(stage(kept), key, "left_semi")


def label_distribution(df: DataFrame, label: str = "sentiment_label") -> DataFrame:
    """Count and percentage per label."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    # a handful of rows: one per label
    share = F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))) * 100
    return counts.withColumn("percent", round_half_even(share, 1))


def run_profile(df: DataFrame, bag: str = "keywords", topics: str | None = None) -> DataFrame:
    """One row of run figures; with the number of tagged responses if ``topics`` is named."""
    figures = [
        F.count("*").alias("responses"),
        F.countDistinct("question_id").alias("questions"),
        F.countDistinct("survey_id").alias("surveys"),
        round_half_even(F.avg("response_length"), 1).alias("avg_response_length"),
        round_half_even(F.avg("word_count"), 1).alias("avg_word_count"),
        F.count_if(F.size(bag) > 0).alias("with_keywords"),
        round_half_even(F.avg(F.when(F.size(bag) > 0, 100.0).otherwise(0.0)), 1)
        .alias("with_keywords_percent"),
    ]
    if topics is not None:
        figures.append(F.count_if(F.size(topics) > 0).alias("with_topics"))
    return df.agg(*figures)


def summary_profile(summary: DataFrame) -> DataFrame:
    """One row: keyword rows, questions and keyword rows per question."""
    rows, questions = F.count("*"), F.countDistinct("question_id")
    return summary.agg(rows.alias("keyword_rows"), questions.alias("questions"),
                       round_half_even(rows / questions, 1).alias("keywords_per_question"))
