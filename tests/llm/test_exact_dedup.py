import hashlib
import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from voxtally.llm import exact_dedup as E

from .samples import awkward_docs, docs_table


def brute(rows):
    body = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for doc, text in rows:
        groups[body(text)].append((-len(text or ""), doc is None, doc))
    out = []
    for doc, text in rows:
        group = groups[body(text)]
        best = min(group, key=lambda g: (g[0], g[1], g[2] or 0))[2]
        out.append((doc, best, len(group), doc == best, hashlib.sha256(body(text).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_same_as_grouping_texts(spark):
    rows = awkward_docs(4) + [(500, "a b c"), (501, "ab c "), (502, "abc"), (503, " abc"), (504, "ABC"),
                              (None, "abc"), (None, None), (505, "abc  "), (505, "abc  "),
                              (506, "é" * 20_000), (507, "é" * 19_999), (508, "é" * 20_000 + " ")]
    got = sorted(map(tuple, E.exact_dedup(docs_table(spark, rows)).collect()), key=repr)
    assert got == brute(rows)
    assert E.exact_dedup(docs_table(spark, [])).collect() == []


def test_chunks_follow_content(spark):
    rng = random.Random(1)
    passage = " ".join("".join(rng.choices("etaoinshrdluéß", k=rng.randint(1, 9))) for _ in range(12_000))
    df = spark.createDataFrame([("", passage), ("x" * 777, passage), ("", "z" * 30_000)], "a string, b string")
    one, other, flat = (r[0] for r in df.select(E.content_chunks(F.concat("a", "b"))).collect())
    as_bytes = passage.encode().decode("latin-1")
    assert "".join(one) == as_bytes and "".join(flat) == "z" * 30_000
    assert all(len(c) <= 8192 for c in [*one, *other, *flat])
    assert all(len(c) >= 256 for c in one[:-1])
    assert len(set(one) & set(other)) >= 0.8 * len(one) > 20
