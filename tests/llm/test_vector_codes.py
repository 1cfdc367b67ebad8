"""Product codes against plain integer k-means, and the transform-domain search against all distances."""

import hashlib
import math
import random

import numpy as np
import pytest

from voxtally.llm.vector_codes import nearest, Transformed, vector_codes

from ..test_catalog import SF


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    ok = [(i, v, lab) for i, v, lab in rows
          if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    with_id = sorted((r for r in ok if r[0] is not None), key=lambda r: r[0])
    if not with_id:
        return []
    dim = len(with_id[0][1])
    ok = [(i, [math.floor(float(x) * scale) for x in v], lab) for i, v, lab in ok if len(v) == dim]
    width = -(-dim // parts)
    cuts = [(min(p * width, dim), min((p + 1) * width, dim)) for p in range(parts)]
    seeds = sorted((r for r in ok if r[0] is not None), key=lambda r: r[0])[:entries]
    books = [[s[1][a:b] for s in seeds] for a, b in cuts]

    def near(part, book):
        d = [sum((x - y) ** 2 for x, y in zip(part, e)) for e in book]
        j = min(range(len(d)), key=lambda j: (d[j], j))
        return j, d[j]

    for _ in range(rounds):
        new = [[list(e) for e in b] for b in books]
        for p, (a, b) in enumerate(cuts):
            groups = {}
            for _, v, _ in ok:
                groups.setdefault(near(v[a:b], books[p])[0], []).append(v[a:b])
            for j, members in groups.items():
                new[p][j] = [sum(col) // len(members) for col in zip(*members)]
        books = new
    out, by_label = [], {}
    for i, v, lab in ok:
        found = [near(v[a:b], books[p]) for p, (a, b) in enumerate(cuts)]
        error = sum(d for _, d in found)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append([i, "".join(f"{j:02x}" for j, _ in found), error, lab])
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return order([(i, c, e, by_label[lab], digest) for i, c, e, lab in out])


def order(rows):
    return sorted(rows, key=lambda r: [(x is None, x if x is not None else 0) for x in r])


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return order(tuple(r) for r in vector_codes(df, **kw).collect())


def vectors(n, dim, seed, spread=0.5):
    rng = random.Random(seed)
    centres = [[rng.uniform(-spread, spread) for _ in range(dim)] for _ in range(5)]
    return [(i, [float(np.float32(c + rng.gauss(0, 0.05))) for c in centres[i % 5]], rng.choice([1, 2, None]))
            for i in range(n)]


def test_awkward_rows(spark):
    rows = vectors(300, 64, 1) + [
        (1000, None, 1), (1001, [0.1] * 63 + [None], 1), (1002, [float("nan")] * 64, 2), (1003, [float("inf")] * 64, 2),
        (1004, [0.2] * 10, 1), (None, [0.3] * 64, None), (5, vectors(6, 64, 1)[5][1], 1),
    ]
    assert run(spark, rows) == brute(rows)


def test_uneven_width_few_rows(spark):
    rows = vectors(12, 21, 2)
    assert run(spark, rows, entries=16) == brute(rows)


def test_large_components(spark):
    rows = [(i, [float(np.float32(v * 1e5)) for v in vec], lab) for i, vec, lab in vectors(60, 16, 3)]
    assert run(spark, rows, parts=4, entries=4, rounds=2) == brute(rows, parts=4, entries=4, rounds=2)


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None, 1)]) == []


def test_transform_search_is_exact():
    rng = np.random.default_rng(4)
    for width in (1, 3, 8, 13):
        book = rng.integers(-50, 50, size=(9, width))
        book[3] = book[1]                                 # ties go to the lower index
        part = np.concatenate([rng.integers(-60, 60, size=(500, width)), book[[1, 3, 7]]])
        code, dist = nearest(part, Transformed(book))
        full = ((part[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        assert (code == full.argmin(axis=1)).all() and (dist == full.min(axis=1)).all()


@pytest.mark.skipif(not SF.exists(), reason="test tables not present")
def test_query_against_brute_force(spark):
    from voxtally.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = order(tuple(r) for r in QUERIES["op13_vector_codes"](spark, str(SF))
                .select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == brute(rows)
