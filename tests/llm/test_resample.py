"""Importance resampling against a brute force in plain Python."""

import hashlib
import math
import re
import zlib

import pytest

from voxtally.llm.resample import exact_ranks, importance_resample

from ..test_catalog import SF

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def order(rows):
    return sorted(rows, key=lambda r: [(x is None, x if x is not None else 0) for x in r])


def brute(docs, targets, longest=1, buckets=10_000, percent=10, least=20):
    def feats(text):
        w = WORD.findall(lower(text))
        return w, [" ".join(w[i:i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for f in feats(text)[1]:
            s[bucket(f)] += 1
    for text in targets:
        for f in feats(text)[1]:
            t[bucket(f)] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for doc, text in docs:
        w, f = feats(text)
        weight = sum(gain[bucket(x)] for x in f)
        score = None
        if doc is not None:
            h = int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc, len(w), len(f), weight, score, None])
    eligible = sorted((r for r in rows if r[0] is not None and r[1] >= least), key=lambda r: (-r[4], r[0]))
    for i, r in enumerate(eligible[:percent * len(eligible) // 100], 1):
        r[5] = i
    return order(tuple(r) for r in rows)


def run(spark, docs, targets, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame([(i, x) for i, x in enumerate(targets)], "item_id long, text string")
    out = importance_resample(d, t, **kw).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
    return order(tuple(r) for r in out.collect())


AWKWARD = [
    (1, None), (2, ""), (3, "ABC abc " * 15), (3, "ABC abc " * 15), (None, "x " * 30),
    (4, "Über straße ÉTÉ 12 34 " * 6), (5, "word " * 100_000), (6, "a,b.c;d e-f " * 5),
    (7, "the cat sat on the mat " * 4), (8, "targets are here and there " * 5),
] + [(i, " ".join(f"w{(i * j) % 37}" for j in range(25))) for i in range(10, 60)]


def test_awkward_rows(spark):
    targets = ["the cat sat", None, "targets are here", "w1 w2 w3"]
    assert run(spark, AWKWARD, targets) == brute(AWKWARD, targets)


def test_longer_runs_and_percent(spark):
    targets = ["the cat sat", "targets are here"]
    assert run(spark, AWKWARD, targets, longest=3, percent=50) == brute(AWKWARD, targets, longest=3, percent=50)


def test_empty_tables(spark):
    assert run(spark, [], ["a b"]) == [] and run(spark, AWKWARD[:4], []) == brute(AWKWARD[:4], [])


def test_exact_ranks_hot_and_split(spark):
    rows = [(i, (i * 7919) % 101, 5 if i % 3 else 0) for i in range(3000)]   # a third share one key
    df = spark.createDataFrame(rows, "id long, a long, b long").repartition(7)
    got = sorted((r.rank, r.b, r.a, r.id) for r in exact_ranks(df, ["b", "a", "id"], ranges=9).collect())
    want = sorted(rows, key=lambda r: (r[2], r[1], r[0]))
    assert got == [(i, b, a, x) for i, (x, a, b) in enumerate(want, 1)]


@pytest.mark.skipif(not SF.exists(), reason="test tables not present")
def test_query_against_brute_force(spark):
    from voxtally.llm.queries import QUERIES
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    targets = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = order(tuple(r) for r in QUERIES["op11_resample"](spark, str(SF))
                .select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect())
    assert got == brute(docs, targets)
