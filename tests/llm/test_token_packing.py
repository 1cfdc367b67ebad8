"""Packing by tokens, in the query, the stage and on texts without spaces."""

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxtally.llm import packing as P
from voxtally.llm.queries import QUERIES
from voxtally.llm.text import map_arrow, release_memory

from ..test_catalog import SF
from .samples import awkward_docs, docs_table

PATH = public_tokenizers.path("byte_bpe_50k.json")


def lengths(texts):
    coder = Tokenizer.from_file(PATH)
    coder.encode_special_tokens = True
    return [len(coder.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_pieces_cover_all_tokens(spark):
    rows = awkward_docs(8) + [(900, "日本語中文字" * 2000), (None, "a b"), (None, None)]
    rows = [(d, t) for d, t in rows if len(t or "") < 20_000]
    out = P.pack_tokens(docs_table(spark, rows), PATH, batch_tokens=8192).collect()
    want = [(d, p, p * 2048, min(2048, n - p * 2048)) for (d, _), n in zip(rows, lengths(t for _, t in rows))
            for p in range(max(1, -(-n // 2048)))]
    assert sorted([(r.doc_id, r.piece, r.start, r.n) for r in out], key=repr) == sorted(want, key=repr)
    assert sum(r.doc_id == 900 for r in out) > 1
    batches = {}
    for r in out:
        assert r.n <= r.bucket <= 2048
        batches[r.bucket, r.batch] = batches.get((r.bucket, r.batch), 0) + r.bucket
    assert max(batches.values()) <= 8192


@pytest.mark.skipif(not SF.exists(), reason="test tables not present")
def test_query_and_stage_measure_tokens(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in rows), lengths(r.text for r in rows)))
    for out in (QUERIES["op7_packing"](spark, str(SF)), corpus_pipeline.packing(spark, docs, str(SF))):
        assert {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("n").alias("n")).collect()} == want


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_freed_memory_is_handed_back():
    """What a task held in pieces, the last of them kept, goes back to the system."""
    pieces = [np.ones(8000) for _ in range(3200)]
    kept, most = pieces[-1], resident()
    del pieces
    release_memory()
    assert kept.sum() == 8000 and resident() < most - 100e6


def test_tasks_release_at_their_end(spark):
    out = map_arrow(spark.range(10), lambda batches: batches, "id long")
    assert sorted(r.id for r in out.collect()) == list(range(10))
