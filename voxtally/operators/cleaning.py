"""Cleaned-text operators. All are map-only unless a lemma table must be joined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_rows
from ..functions.text import as_text, clean_text, clean_tokens, drop_words, word_count
from ..session import INLINE_LIMIT, bounded_rows
from .reshape import quoted, text_columns


def one_value(table: DataFrame, word: str, value: str) -> DataFrame:
    """``(word, value)`` with each word once: of several values the smallest; NULLs go.

    Applied before a table's size is looked at, so that short and long tables
    follow the same rule.
    """
    return (table.filter(F.col(word).isNotNull() & F.col(value).isNotNull())
            .groupBy(F.col(word).alias("word")).agg(F.min(value).alias("value")))


def lemma_dict(lemmas: DataFrame | None) -> dict[str, str] | None:
    """A ``(word, lemma)`` table as a dictionary if short enough to inline, else None."""
    if lemmas is None:
        return {}
    rows = bounded_rows(one_value(lemmas, "word", "lemma"), INLINE_LIMIT)
    return None if rows is None else {r["word"]: r["value"] for r in rows}


def with_entries(df: DataFrame, tokens: Column, table: DataFrame, key: str, out: str) -> DataFrame:
    """Add ``out``: a map of the row's tokens found in a ``(word, value)`` table of any size.

    Only distinct tokens that are in the table are shuffled by key; the rows
    themselves are shuffled once, to join the maps back.
    """
    words = explode_rows(df, [key], F.array_distinct(tokens), "word")
    found = words.join(table.select("word", "value"), "word").groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("word", "value"))).alias(out))
    return df.join(found, key, "left")


def lemmatise_joined(df: DataFrame, tokens: Column, lemmas: DataFrame, key: str,
                     out: str) -> DataFrame:
    """Lemmatise a token array through a table of any size."""
    return with_entries(df, tokens, one_value(lemmas, "word", "lemma"), key, "_lemma").withColumn(out, F.transform(
        tokens, lambda t: F.coalesce(F.try_element_at("_lemma", t), t))).drop("_lemma")


def preprocess(df: DataFrame, stop: Sequence[str], lemmas: dict[str, str] | DataFrame | None = None,
               key: str = "response_id") -> DataFrame:
    """Keep raw copies, clean question and response text, add both lengths."""
    if isinstance(lemmas, DataFrame):
        inline = lemma_dict(lemmas)
        if inline is None:
            return _preprocess_joined(df, stop, lemmas, key)
        lemmas = inline
    return _keep_raw(df).withColumns({
        "question_text": clean_text(F.col("question_text"), stop, lemmas),
        "response_text": clean_text(F.col("response_text"), stop, lemmas),
    }).withColumn("word_count", word_count(F.col("response_text")))


def _keep_raw(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "question_text_original": F.col("question_text"),
        "response_text_original": F.col("response_text"),
        "response_length": F.length("response_text"),
    })


def _preprocess_joined(df: DataFrame, stop: Sequence[str], lemmas: DataFrame,
                       key: str) -> DataFrame:
    """Both columns at once: one explode, one join with the table, one join back."""
    tokens = {name: drop_words(clean_tokens(F.col(name)), stop) for name in ("question_text", "response_text")}
    table = one_value(lemmas, "word", "lemma")
    named = with_entries(_keep_raw(df), F.concat(*tokens.values()), table, key, "_lemma")
    return named.withColumns({name: F.array_join(F.transform(
        words, lambda t: F.coalesce(F.try_element_at("_lemma", t), t)), " ")
        for name, words in tokens.items()}).drop("_lemma").withColumn(
            "word_count", word_count(F.col("response_text")))


def preprocess_columns(df: DataFrame, stop: Sequence[str], lemmas: dict[str, str] | None = None,
                       columns: Sequence[str] | None = None) -> DataFrame:
    """Clean the given columns (default: all detected text columns) in place."""
    names = list(columns) if columns is not None else text_columns(df)
    return df.withColumns({c: clean_text(as_text(quoted(c)), stop, lemmas) for c in names})
