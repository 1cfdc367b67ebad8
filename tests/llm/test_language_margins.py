"""Rejection of languages that were never learned and of short ties."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from voxtally.llm import language as L

from ..test_catalog import SF
from .samples import docs_table


@pytest.mark.skipif(not SF.exists(), reason="test tables not present")
def test_left_out_language_is_rejected(spark):
    docs = spark.read.parquet(f"{SF.parent}/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held = L.fold(F.col("doc_id")) == 2
    model = L.learn_dictionaries(docs.filter(~held))
    long = docs.filter(held & (F.length("text") >= 200))
    learned = L.identify_language(long, model, min_bytes=0).collect()
    assert sum(r.rejected for r in learned) <= 0.02 * len(learned)
    total = rejected = 0
    for lang in model:
        rest = {k: v for k, v in model.items() if k != lang}
        out = L.identify_language(long.filter(F.col("lang") == lang), rest).collect()
        total, rejected = total + len(out), rejected + sum(r.rejected for r in out)
    assert total > 100 and rejected >= 0.8 * total


def test_short_ties_do_not_pass_the_pipeline(spark):
    same = L.identify_language(docs_table(spark, [(4, "ka lo mi")]), {"x": b"abc", "y": b"abc"}, min_bytes=0).first()
    assert (same.lang_pred, same.score, same.rejected) == ("x", 0.0, True)
    learned = [(i, text, lang) for i, (text, lang) in enumerate(
        [("kalo mine tuka lomi neka tulo", "aa"), ("schein ungver einver schung verein", "bb")] * 20)]
    docs = spark.createDataFrame([*learned, (90, "q", None)], "doc_id long, text string, lang string")
    left = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert left == set(range(40))
