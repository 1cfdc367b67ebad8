"""Enrich a streaming response table.

Only the row-level steps apply to a stream: cleaning, word-set sentiment,
key phrases and matching a fixed list. They keep no state, so they need no
watermark. Topic inference and summaries need the whole corpus and stay batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import cleaning, keyphrases, sentiment, topics


def enrich_stream(responses: DataFrame, stop: Sequence[str], vocabulary: Sequence[str] = (),
                  topic_names: Sequence[str] = (), lemmas: dict[str, str] | None = None) -> DataFrame:
    """Add cleaned text, sentiment, keyword bag and topics; works on batches too."""
    df = cleaning.preprocess(responses, stop, lemmas)
    df = sentiment.add_wordset_sentiment(df)
    df = keyphrases.add_keywords(df, stop, list(vocabulary))
    return topics.with_topics(df, list(topic_names), "response_text_original")
