"""A corpus from raw documents to packed batches, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``, works on all its predecessor kept,
and all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm.decontaminate import decontaminate
from voxtally.llm.language import identify_language, learn_dictionaries
from voxtally.llm.line_dedup import line_dedup
from voxtally.llm.near_dedup import near_dedup
from voxtally.llm.packing import pack_tokens
from voxtally.llm.text import SPACED_WORD
from voxtally.session import stage


def drop_ids(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose id is not in the table ``dropped``; NULL is an id.

    The dropped ids are written first: they are broadcast while they are few,
    and then no text moves.
    """
    gone = stage(dropped.select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_gone")), "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts whose language cannot be told, of any length; the model is fitted on the labelled rows."""
    judged = identify_language(docs, learn_dictionaries(docs), min_bytes=0, prefix="_")
    return judged.filter(~F.col("_rejected")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated lines; a document that loses all its words goes too."""
    kept = line_dedup(docs).filter((F.col("n_dropped") == 0) | F.col("text").rlike(SPACED_WORD))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: five-word shingles, similarity 0.8 or more."""
    found = near_dedup(docs, shingle=5, percent=80)
    return drop_ids(docs, found.filter("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with an occurrence of a benchmark window."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drop_ids(docs, found.filter("contaminated"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every piece of every document in a padded batch; lengths and budgets are in tokens."""
    return pack_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates),
          ("decontamination", decontamination), ("packing", packing)]

# Compression and the optimal buckets have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
