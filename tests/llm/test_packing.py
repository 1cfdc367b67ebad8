import itertools
import random

import pytest
from pyspark.sql import functions as F

from voxtally.llm import packing as P

from .samples import WORD, awkward_docs, docs_table


def padding(counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in counts.items())


@pytest.mark.parametrize("seed", range(6))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    counts = {n: rng.randint(1, 9) for n in rng.sample(range(40), 9)}
    for k in (1, 2, 3, 20):
        got = P.best_boundaries(counts, k)
        lengths = sorted(counts)
        choices = [c for r in range(1, min(k, 9) + 1) for c in itertools.combinations(lengths, r) if c[-1] == lengths[-1]]
        assert len(got) <= k and padding(counts, got) == min(padding(counts, c) for c in choices)
    assert P.best_boundaries({}, 3) == []


def test_pieces_batches_and_slots(spark):
    rows = awkward_docs(6) + [(3, "again a"), (None, "a b"), (None, None)]
    out = P.pack(docs_table(spark, rows), max_length=64, buckets=4, batch_tokens=300).collect()
    want = []
    for doc, text in rows:
        n = len(WORD.findall(text or ""))
        want += [(doc, p, p * 64, min(64, n - p * 64)) for p in range(max(1, -(-n // 64)))]
    assert sorted([(r.doc_id, r.piece, r.start, r.n) for r in out], key=repr) == sorted(want, key=repr)
    bounds = sorted({r.bucket for r in out})
    assert len(bounds) <= 4
    for r in out:
        assert r.bucket == min(b for b in bounds if b >= r.n)
    for b in bounds:
        room, own = max(1, 300 // max(b, 1)), sorted((r.batch, r.slot) for r in out if r.bucket == b)
        assert own == [(i // room, i % room) for i in range(len(own))]
        ids = [r.doc_id for r in sorted((r for r in out if r.bucket == b and r.doc_id is not None), key=lambda r: (r.batch, r.slot))]
        assert ids == sorted(ids)


def test_own_length_and_empty_table(spark):
    df = docs_table(spark, [(1, "abc"), (2, None)])
    got = {r.doc_id: r.n for r in P.pack(df, length=F.length("text")).collect()}
    assert got == {1: 3, 2: 0}
    assert P.pack(docs_table(spark, [])).collect() == []
