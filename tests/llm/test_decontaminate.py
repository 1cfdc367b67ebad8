import random

from voxtally.llm import decontaminate as D

from .samples import LOWER, awkward_docs, docs_table
import re

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window):
    words = lambda t: WORDS.findall((t or "").translate(LOWER))
    windows = set()
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        windows |= {(tuple(w[i:i + n]), item) for i in range(len(w) - n + 1) if n}
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for win, item in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found |= {str(item)} if item is not None else set()
        out[doc] = (len(w), len(hit), sorted(found), bool(hit))
    return out


def table(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_same_as_looking_everywhere(spark):
    rng = random.Random(2)
    docs = [(d, t) for d, t in awkward_docs(5) if len(t or "") < 9000]
    texts = [t for _, t in docs if t and len(t.split()) > 20]
    items = []
    for i in range(12):
        words = rng.choice(texts).split()
        at = rng.randrange(len(words) - 12)
        items.append((i, " ".join(words[at:at + rng.choice([1, 2, 3, 5, 10, 12])]).upper()))
    items += [(20, "one"), (21, "ab"), (22, None), (23, ""), (24, "..."), (None, "two words"),
              (25, items[0][1]), (9, "w1, w2; (w3)"), (26, "Été")]
    docs += [(900, "w1 w2-W3"), (901, "ÉTÉ"), (902, "one one one"), (903, "é")]
    for window in (10, 4, 1):
        got = {r[0]: tuple(r[1:]) for r in D.decontaminate(docs_table(spark, docs), table(spark, items), window).collect()}
        assert got == brute(docs, items, window)


def test_repeats_nulls_and_empty_tables(spark):
    docs = docs_table(spark, [(1, "a b c"), (1, "x y"), (None, "a b c"), (2, None)])
    got = sorted(map(tuple, D.decontaminate(docs, table(spark, [(5, "a b")])).collect()), key=repr)
    assert got == sorted([(1, 3, 2, ["5"], True), (1, 2, 2, ["5"], True), (None, 3, 2, ["5"], True),
                          (2, 0, 0, [], False)], key=repr)
    none = D.decontaminate(docs, table(spark, [])).collect()
    assert [r.n_hit for r in none] == [0] * 4
    assert D.decontaminate(docs_table(spark, []), table(spark, [(5, "a b")])).collect() == []
