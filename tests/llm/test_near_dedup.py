import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.llm import near_dedup as N
from voxtally.llm.graph import components as spark_components
from voxtally.llm.hashing import shingle_sets

from .samples import LOWER, WORD, awkward_docs, components, docs_table


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if 0 < len(words) < size:
        return {tuple(words)}
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def brute(rows, size, percent):
    sets = {d: shingles(t, size) for d, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = components(sets, links)
    return {d: (len(sets[d]), c, c == d) for d, c in found.items()}


def judged(df, **options):
    return {r[0]: tuple(r[1:]) for r in N.near_dedup(df, **options).collect()}


@pytest.mark.parametrize(("size", "percent", "seed"), [(3, 85, 1), (5, 80, 2), (1, 50, 3)])
def test_same_as_all_pairs(spark, size, percent, seed):
    rows = awkward_docs(seed)
    got = judged(docs_table(spark, rows), shingle=size, percent=percent, rows=5 if percent > 60 else 2)
    assert got == brute(rows, size, percent)


def test_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(5000)}"
        rows.append((i, " ".join(words)))
    want = brute(rows, 3, 85)
    assert judged(docs_table(spark, rows, False), shingle=3, percent=85) == want
    assert 1 < len({c for _, c, _ in want.values()}) < 150


def test_nulls_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"),
            (9, "A B C D E F"), (7, None), (8, ""), (2, "p q r s t u"), (9, "p q r s t u")]
    got = sorted(map(tuple, N.near_dedup(docs_table(spark, rows), shingle=3).collect()), key=repr)
    assert got == sorted([(None, 4, None, True), (None, 4, None, True), (4, 4, 2, False), (4, 4, 2, False),
                          (9, 4, 2, False), (9, 4, 2, False), (7, 0, 7, True), (8, 0, 8, True),
                          (2, 4, 2, True)], key=repr)
    assert N.near_dedup(docs_table(spark, [])).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for size in (3, 40, 3000):
        pool = rng.integers(0, 2**63, 2 * size, dtype=np.uint64)
        one, two = np.unique(pool[:size]), np.unique(pool[size // 4:size + size // 4])
        true = len(np.intersect1d(one, two)) / len(np.union1d(one, two))
        a, b = N.super_minhash([one, two], 200)
        assert abs(float((a == b).mean()) - true) < 0.12
        assert (a != N.EMPTY).all()
    assert (N.super_minhash([np.empty(0, np.uint64)], 8) == N.EMPTY).all()


def test_a_signature_does_not_depend_on_its_batch():
    sets = [np.unique(np.random.default_rng(i).integers(0, 2**63, n, dtype=np.uint64))
            for i, n in enumerate((1, 7, 300, 2, 0, 40_000))]
    together = N.super_minhash(sets, 60)
    for i, s in enumerate(sets):
        assert (N.super_minhash([s], 60)[0] == together[i]).all()


def test_shingle_hashes_follow_words():
    import pyarrow as pa
    texts = ["a b c d", "A  b\tc\nd", "a b c d e", None, "", "a b", "ab", " a b "]
    sets = shingle_sets(pa.array(texts), 3)
    assert [len(s) for s in sets] == [2, 2, 3, 0, 0, 1, 1, 1]
    assert (sets[0] == sets[1]).all() and (sets[5] == sets[7]).all() and sets[5][0] != sets[6][0]
    sliced = shingle_sets(pa.array(["zzz", *texts]).slice(1), 3)
    assert all((x == y).all() for x, y in zip(sets, sliced))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(60, 90)]
    links += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    rng.shuffle(links)
    got = {r.node: r.component for r in spark_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    want = components({x for e in links for x in e}, links)
    assert got == {x: want[x] for x in nodes}
    assert spark_components(spark.createDataFrame([], "a long, b long")).collect() == []


def prefix_brute(sets, percent):
    held = {}
    for s in sets:
        for t in s:
            held[t] = held.get(t, 0) + 1
    out = []
    for node, s in enumerate(sets):
        size = len(s) - -(-percent * len(s) // 100) + 1
        for at, t in enumerate(sorted(s, key=lambda t: (held[t], t))[:size]):
            if held[t] > 1:
                out.append((node, t, len(s), at, round(sum(held[u] for u in s) / len(s), 3)))
    return sorted(out)


def test_prefix_holds_the_rarest_tokens_that_others_share(spark):
    rng = random.Random(8)
    sets = [sorted(rng.sample(range(-60, 60), rng.randint(1, 40))) + [1000 + i] for i in range(40)]
    rows = [(i, i, len(s), s) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "row long, node long, n int, tokens array<long>")
    for percent in (50, 80):
        got = N.prefix_entries(df, percent).collect()
        assert sorted((r.node, r.token, r.n, r.at, round(r.common, 3)) for r in got) == prefix_brute(sets, percent)


def test_prefix_of_sets_that_share_little_stays_empty_in_a_large_corpus(spark):
    # pairs of sets share 100 of 1000 tokens, which the prefix of 201 rarest does not reach; 3.8 million distinct tokens in all
    token = F.expr("transform(sequence(0, 999), i -> xxhash64(if(i < 100, id div 2, id + 1000000000), i))")
    sets = spark.range(4000).select(F.col("id").alias("row"), F.col("id").alias("node"), F.lit(1000).alias("n"), token.alias("tokens"))
    assert N.prefix_entries(sets, 80).count() == 0
