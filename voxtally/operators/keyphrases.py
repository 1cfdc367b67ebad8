"""Keyword bags per response."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phrases as P
from ..functions.arrays import explode_rows
from ..functions.text import strip
from ..functions.wordlists import GENERIC_WORDS
from ..session import stage
from .matching import Keywords, with_matches


def rake_candidates(df: DataFrame, text: str, key: str, stop: Sequence[str]) -> DataFrame:
    """``(key, pos, phrase)``: candidate phrases in text order."""
    return explode_rows(df, [key], P.candidate_phrases(F.col(text), stop), "phrase", "pos")


def rake_scores(df: DataFrame, text: str, key: str, stop: Sequence[str]) -> DataFrame:
    """``(key, phrase, score)`` per distinct phrase of a text."""
    return explode_rows(df, [key], P.ranked_phrases(F.col(text), stop), "p").select(
        key, "p.phrase", "p.score")


def bag_rows(df: DataFrame, bag: str, *keys: str) -> DataFrame:
    """One row per bag entry: keys, rank (from 0), keyword, count."""
    return explode_rows(df, list(keys), F.col(bag), "_e", "rank").select(
        *keys, "rank", F.col("_e.keyword").alias("keyword"), F.col("_e.count").alias("count"))


def add_keywords(df: DataFrame, stop: Sequence[str], vocabulary: Keywords | None = None,
                 text: str = "response_text_original", key: str = "response_id",
                 excluded: Sequence[str] = GENERIC_WORDS, k: int = 5,
                 similar: Callable[[DataFrame], DataFrame] | None = None,
                 out: str = "keywords") -> DataFrame:
    """Add the keyword bag: top phrases, then vocabulary words found in the text.

    ``similar`` is an optional filter on the table of distinct phrases
    (``keyword``), keeping those near the vocabulary; without it all pass.
    """
    df = df.withColumn(out, P.top_phrases(F.col(text), stop, excluded, k))
    if similar is not None:
        df = keep_similar(df, out, similar, key)
    if vocabulary is None:
        return df
    bag = F.col(out)
    found = F.when(F.length(strip(F.col(text))) >= 3, F.col("_found")).otherwise(
        F.array().cast("array<string>"))
    return with_matches(df, vocabulary, text, "_found", key).withColumn(
        out, P.boost(bag, found)).drop("_found")


def frequent_keywords(df: DataFrame, stop: Sequence[str], text: str = "response_text_original",
                      key: str = "response_id", excluded: Sequence[str] = GENERIC_WORDS, k: int = 5,
                      lemmas: dict[str, str] | None = None,
                      similar: Callable[[DataFrame], DataFrame] | None = None,
                      out: str = "keywords") -> DataFrame:
    """Add a bag of the most frequent cleaned and lemmatised tokens, near the vocabulary."""
    df = df.withColumn(out, P.frequent_tokens(F.col(text), stop, excluded, k, lemmas))
    return df if similar is None else keep_similar(df, out, similar, key)


def keep_similar(df: DataFrame, bag: str, similar: Callable[[DataFrame], DataFrame],
                 key: str) -> DataFrame:
    """Reduce each bag to the keywords that ``similar`` keeps.

    The bags are written once, since three steps read them. Each distinct
    keyword is judged once; the survivors are joined back to the bag entries and
    collected per row in rank order.
    """
    base = stage(df)
    entries = bag_rows(base, bag, key)
    kept = similar(entries.select("keyword").distinct()).select("keyword")
    packed = entries.join(kept, "keyword").groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct("rank", "keyword", "count"))).alias("_kept"))
    return base.drop(bag).join(packed, key, "left").withColumn(bag, F.coalesce(
        F.transform("_kept", lambda x: F.struct(x["keyword"].alias("keyword"),
                                                x["count"].alias("count"))),
        F.array().cast(P.BAG))).drop("_kept")


def per_distinct_text(df: DataFrame, text: str, out: str,
                      expression: Callable[[Column], Column]) -> DataFrame:
    """Evaluate ``expression`` once per distinct text and join the result back.

    Worth its two shuffles only where copies of long texts dominate; equal texts
    get equal results either way, since the expression depends on the text only.
    A text with very many copies is split by AQE's skew join.
    """
    distinct = df.select(F.col(text).alias("_t")).filter("_t is not null").distinct()
    results = distinct.withColumn(out, expression(F.col("_t")))
    # a NULL text joins with nothing and gets what the expression gives for it; given as a literal,
    # since a Python function in it is evaluated for every row
    return df.join(results, F.col(text) == F.col("_t"), "left").drop("_t").withColumn(
        out, F.coalesce(F.col(out), F.when(F.col(text).isNull(), expression(F.lit(None).cast("string")))))
