"""Suffix-tree scoring against a brute force in plain Python."""

import glob
import math
import os
import re
import threading
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from voxtally.llm import suffix_lm as module
from voxtally.llm.suffix_lm import suffix_lm

from ..test_catalog import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def toks(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return WORD.findall(low) + [""]


def brute(rows, depth=2, min_count=3, threshold=8.0):
    held = {r: doc is None or zlib.crc32(str(doc).encode()) % 5 == 1 for r, (doc, _) in enumerate(rows)}
    pairs = defaultdict(Counter)
    for r, (doc, text) in enumerate(rows):
        if held[r]:
            continue
        t = toks(text)
        for i, x in enumerate(t):
            for k in range(0, min(depth, i) + 1):
                pairs[" ".join(t[i - k:i])][x] += 1
    n_c = {c: sum(v.values()) for c, v in pairs.items()}
    N, V = n_c.get("", 0), len(pairs.get("", {}))
    kept = set()
    for c, v in pairs.items():
        if c == "":
            continue
        p = " ".join(c.split(" ")[1:])
        g = 2 * sum(n * math.log((n / n_c[c]) / (pairs[p][x] / n_c[p])) for x, n in v.items())
        if n_c[c] >= min_count and g >= threshold:
            w = c.split(" ")
            kept |= {" ".join(w[j:]) for j in range(len(w))}
    out = []
    for r, (doc, text) in enumerate(rows):
        t = toks(text)
        base = score = 0.0
        known = 0
        for i, x in enumerate(t):
            c = pairs.get("", {}).get(x, 0)
            known += c > 0
            p = (c + 0.5) / (N + 0.5 * (V + 1))
            base += math.log10(p)
            for k in range(1, min(depth, i) + 1):
                ctx = " ".join(t[i - k:i])
                if ctx not in kept:
                    break
                u = len(pairs[ctx])
                p = (pairs[ctx].get(x, 0) + u * p) / (n_c[ctx] + u)
            score += math.log10(p)
        out.append((doc, held[r], len(t), known, N, base, score))
    return out


def same(got, want):
    key = lambda r: [(x is None, x if x is not None else 0) for x in r]
    got, want = sorted(got, key=key), sorted(want, key=key)
    return len(got) == len(want) and all(
        g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9)
        and math.isclose(g[6], w[6], rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want))


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = suffix_lm(df, **kw).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return [tuple(r) for r in out.collect()]


PHRASES = ["the cat sat on the mat", "the cat ran off", "a dog sat on the rug", "The Cat sat on THE mat again"]
ROWS = [(i, PHRASES[i % 4] + " " + " ".join(f"w{i % 7}" for _ in range(i % 5))) for i in range(60)] + [
    (100, None), (101, ""), (102, "   \t\n "), (103, "x " * 50_000), (None, "the cat"), (7, "the cat sat on the mat"),
    (104, "Über straße über"), (105, "the"),
]


def test_awkward_rows(spark):
    assert same(run(spark, ROWS), brute(ROWS))


def test_deeper_and_looser(spark):
    assert same(run(spark, ROWS, depth=3, min_count=2, threshold=1.0), brute(ROWS, 3, 2, 1.0))


def test_empty(spark):
    assert run(spark, []) == []
    only_held = [(r, t) for r, t in ROWS if r is not None and zlib.crc32(str(r).encode()) % 5 == 1]
    assert same(run(spark, only_held), brute(only_held))


@pytest.mark.skipif(not SF.exists(), reason="test tables not present")
def test_query_against_brute_force(spark):
    from voxtally.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in QUERIES["op12_suffix_lm"](spark, str(SF)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()]
    assert same(got, brute(rows))


def test_shuffles_less_than_four_times_the_text(spark):
    """The most that Spark's own folders hold at a time, looked at every 20 ms."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"{w:x}" for w in rng.integers(0, 3000, 800))) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dirs = [d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    sizes, done = [], threading.Event()

    def held():
        return sum(os.path.getsize(f) for d in dirs for f in glob.glob(f"{d}/*/shuffle_*") if os.path.exists(f))

    def watch():
        while not done.wait(0.02):
            try:
                sizes.append(held())
            except FileNotFoundError:       # deleted while looked at
                pass

    before, watcher = held(), threading.Thread(target=watch)
    watcher.start()
    try:
        suffix_lm(df).write.format("noop").mode("overwrite").save()
    finally:
        done.set()
        watcher.join()
    assert (max(sizes) - before) / sum(len(t) for _, t in rows) < 4


@pytest.mark.parametrize("depth", [2, 3])
def test_heavy_words_and_merged_events(monkeypatch, depth):
    """The steps of one job, in this process: contexts of heavy words dealt over parts, equal events added up early."""
    for name, value in (("HEAVY", 20), ("PENDING", 40), ("CHUNK", 300), ("SPOOL", 6400)):
        monkeypatch.setattr(module, name, value)
    rows = [r for r in ROWS if r[0] is not None and r[0] != 103] + [(103, "x " * 500)]
    rows = list({r[0]: r for r in rows}.values())
    texts = pa.RecordBatch.from_arrays([
        pa.array(range(len(rows))), pa.array([zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]),
        pa.array([t for _, t in rows])], names=["_row", "held_out", "_text"])
    buckets, salt = 2, 3
    words = pa.Table.from_batches(module.count_words(iter([texts]), buckets, salt)).sort_by("name")
    counted = pa.Table.from_batches(module.add_words(iter(words.to_batches(max_chunksize=7)))).to_pylist()
    totals = [r for r in counted if r["bucket"] is None]
    n, v, heavy = totals[0]["n"], totals[0]["v"], totals[0]["heavy"]
    assert len(totals) == 1 and len(heavy) > 2 and not totals[0]["clash"]
    blocks = [{k: r[k] for k in module.BLOCK.names} for r in counted if r["bucket"] is not None] + [
        r for b in module.cut_events(iter([texts]), depth, buckets, salt, 3, heavy, 4) for r in b.to_pylist()]
    placed = pa.Table.from_pylist(sorted(blocks, key=lambda r: r["bucket"]), module.BLOCK)
    sums = defaultdict(lambda: [0, 0, 0.0, 0.0])
    for found in module.score_buckets(iter(placed.to_batches(max_chunksize=5)), light=3, n=n, v=v, depth=depth,
                                      min_count=3, threshold=8.0):
        for row, *values in zip(*found.to_pydict().values()):
            sums[row] = [a + b for a, b in zip(sums[row], values)]
    got = [(d, zlib.crc32(str(d).encode()) % 5 == 1, *sums[i][:2], n, *sums[i][2:]) for i, (d, _) in enumerate(rows)]
    assert same(got, brute(rows, depth))


def test_names_that_clash_are_found():
    batch = pa.RecordBatch.from_pylist([
        {"name": 5, "word": w, "n": 1, "buckets": b"\0\0"} for w in ("a", "a", "b")])
    for rows, clash in ((batch.slice(0, 2), False), (batch, True)):
        out = pa.Table.from_batches(module.add_words(iter([rows.slice(0, 1), rows.slice(1)]))).to_pylist()
        assert out[-1]["clash"] is clash
