"""Lines of few words: exact copies at every length, one-character edits of long ones."""

import random

import corpus_pipeline
import pytest

from voxtally.llm import line_dedup as L

from ..test_catalog import SF
from .samples import WORD, awkward_docs, docs_table
from .test_line_dedup import result, within_one


def brute(rows):
    seen, out = {}, {}
    for doc, text in sorted(rows):
        keep, dropped = [], 0
        for line in text.split("\n") if text is not None else []:
            words = WORD.findall(line)
            units = words if len(words) >= 8 else list("".join(words))
            by_words = len(words) >= 8
            if words:
                near = tuple(words) in seen or (by_words or len(units) >= 16) and any(
                    b == by_words and (b or len(s) >= 16) and abs(len(s) - len(units)) <= 1
                    and (set(s) ^ set(units)).__len__() <= 2 and within_one(s, units) for b, s in seen.values())
                seen[tuple(words)] = by_words, units
                if near:
                    dropped += 1
                    continue
            keep.append(line)
        out[doc] = (None if text is None else "\n".join(keep), len(keep) + dropped, dropped)
    return out


def short_lines(seed):
    rng = random.Random(seed)
    letters = "日本語中文字é𝒳ab "
    bases = ["".join(rng.choices(letters, k=rng.randint(1, 30))) for _ in range(8)]
    rows = []
    for doc in range(30):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(bases))
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(line))
                edit = rng.randrange(3)
                line[at:at + (edit != 0)] = [] if edit == 1 and len(line) > 1 else [rng.choice(letters)]
            lines.append("".join(line))
        rows.append((doc, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("rows", [short_lines(1), short_lines(2),
                                  [(d, t) for d, t in awkward_docs(4) if len(t or "") < 4000]])
def test_same_as_all_earlier_lines(spark, rows):
    assert result(docs_table(spark, rows)) == brute(rows)


def test_boilerplate_and_unspaced_lines(spark):
    line = "一二三四五六七八九十甲乙丙丁戊己庚辛"
    rows = [(1, "Released under the MIT License.\nown\n"), (2, "x\n\nReleased  under the MIT License.\n"), (3, line),
            (4, f"{line[:5]}子{line[6:]}"), (5, f"{line}丑"), (6, f"{line[:3]}子丑{line[5:]}"), (7, "own")]
    got = {d: (text, dropped) for d, (text, _, dropped) in result(docs_table(spark, rows)).items()}
    assert got == {1: ("Released under the MIT License.\nown\n", 0), 2: ("x\n\n", 1), 3: (line, 0), 4: ("", 1), 5: ("", 1),
                   6: (rows[5][1], 0), 7: ("", 1)}


@pytest.mark.skipif(not SF.exists(), reason="test tables not present")
def test_pipeline_drops_short_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, want = set(), {}
    for doc, text in sorted((r.doc_id, r.text) for r in docs.collect()):
        want[doc] = set()
        for line in (text or "").split("\n"):
            words = tuple(WORD.findall(line))
            if words and words not in seen:
                want[doc].add(words)
            seen.add(words)
    left = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, str(SF)).collect()}
    for doc, text in left.items():
        assert {tuple(WORD.findall(x)) for x in (text or "").split("\n")} <= want[doc] | {()}
