import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxtally.llm import line_dedup as L

from .samples import WORD, awkward_docs, docs_table


def within_one(a, b):
    """Word-level edit distance of at most one, by the full table."""
    table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return table[-1][-1] <= 1


def brute(rows, least):
    seen, out = [], {}
    for doc, text in sorted(rows):
        keep, dropped = [], 0
        for line in text.split("\n") if text is not None else []:
            words = WORD.findall(line)
            if len(words) >= least:
                near = any(abs(len(s) - len(words)) <= 1 and within_one(s, words) for s in seen)
                seen.append(words)
                if near:
                    dropped += 1
                    continue
            keep.append(line)
        out[doc] = (None if text is None else "\n".join(keep), len(keep) + dropped, dropped)
    return out


def result(df, **options):
    return {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in L.line_dedup(df, **options).collect()}


def near_lines(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    bases = [rng.choices(words, k=rng.randint(3, 11)) for _ in range(6)]
    rows = []
    for doc in range(25):
        lines = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(bases))
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(line))
                edit = rng.randrange(3)
                line[at:at + (edit != 0)] = [] if edit == 1 else [rng.choice(words)]
            lines.append(" ".join(line))
        rows.append((doc, "\n".join(lines)))
    return rows


@pytest.mark.parametrize(("rows", "least"), [(near_lines(1), 4), (near_lines(2), 2), (near_lines(3), 8),
                                             ([(d, t) for d, t in awkward_docs(3) if len(t or "") < 9000], 5)])
def test_same_as_all_earlier_lines(spark, rows, least):
    assert result(docs_table(spark, rows), least=least) == brute(rows, least)


def test_common_line_with_variants(spark):
    base = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(base[:i % 12] + [f"v{i}"] + base[i % 12 + 1:])) for i in range(60)]
    rows += [(100 + i, " ".join(base)) for i in range(30)]
    assert result(docs_table(spark, rows, False)) == brute(rows, 8)


def test_nulls_long_texts_repeats_and_columns(spark):
    line = "one two three four five six seven eight"
    long = "\n".join(f"{line} {i} {i}" for i in range(3000))
    rows = [(None, line), (1, line), (1, line), (2, None), (3, ""), (4, long), (5, f"{line}\r\nshort")]
    df = docs_table(spark, rows)
    out = L.line_dedup(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    assert {r.number for r in out.select("number").distinct().collect()} == {"other"}
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_dropped))
    assert got[1] == [(line, 1, 0)] * 2 and got[None] == [("", 1, 1)]
    assert got[2] == [(None, 0, 0)] and got[3] == [("", 1, 0)]
    assert got[4] == [(long, 3000, 0)] and got[5] == [("short", 2, 1)]
    again = L.line_dedup(df.select("doc_id", "text").withColumn("n_lines", F.lit("x")))
    assert again.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert L.line_dedup(docs_table(spark, [])).collect() == []


def test_lines_of_a_batch():
    lines = L.Lines(pa.array(["a b c\n\nd e f g", None, "", "\nh i j", "k l m\n"]), 3)
    assert lines.doc.tolist() == [0, 0, 3, 4] and lines.number.tolist() == [0, 2, 1, 0]
    assert lines.size.tolist() == [3, 4, 3, 3]
    same = L.Lines(pa.array(["x y\na  b\tc", "a b c"]), 3)
    assert len(np.unique(same.whole()[0])) == 1
