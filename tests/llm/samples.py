"""Small awkward tables and brute-force versions for the operator tests."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# names that operators use inside
CLASHING = ("n", "node", "words", "recipe", "place", "number", "bands", "key", "batch", "slot",
            "spans", "h", "at", "size", "kept", "component", "_id", "lang_pred", "group_size", "low")


def awkward_docs(seed: int = 7, n: int = 60) -> list[tuple]:
    """Copies, near copies, shared lines, short, blank, NULL and very long texts, ties."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)] + ["Straße", "naïve", "ÉTÉ", "été", "日本語", "x."]

    def text(lines: int) -> str:
        return "\n".join(" ".join(rng.choices(vocabulary, k=rng.randint(1, 24))) for _ in range(lines))

    base = [text(rng.randint(1, 6)) for _ in range(n // 3)]
    out = list(base)
    for _ in range(n // 3):
        words = rng.choice(base).split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        out.append(" ".join(words))
    common = text(2)
    out += [f"{common}\n{text(1)}" for _ in range(n // 6)]
    out += [rng.choice(base) for _ in range(n // 12)]
    out += [None, "", " \t\n ", "one", "two words", "TWO words", "a  b\tc", "ab c", "\n\n", "x" * 5000,
            " ".join(rng.choices(vocabulary, k=30_000))]
    rng.shuffle(out)
    return list(enumerate(out))


def docs_table(spark, rows, extra: bool = True):
    """``doc_id, text`` and columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if not extra:
        return df
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit("other") for c in CLASHING}).repartition(3)


def components(nodes, links):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}
