"""Term weights from packed blocks against brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest

from voxtally.operators import term_blocks, topics

STOP = ["the"]


def corpus(spark, docs=120, seed=3):
    """Keys repeat and are NULL, texts are NULL, blank, without a word, or one word often."""
    draw = random.Random(seed)
    words = [f"w{i}ord" for i in range(30)] + ["the", "straße", "données", "語彙", "a", "x_1"]
    texts = [" ".join(draw.choice(words[:1 + draw.randrange(len(words))]) for _ in range(draw.randrange(1, 40)))
             for _ in range(docs)]
    texts += [None, "", " \n ", "?! ...", "the the", "W0ord " * 300]
    keys = [None if i % 17 == 5 else i // 2 if i % 3 else i for i in range(len(texts))]
    rows = list(zip(keys, texts))
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "id long, t string").repartition(5)


def brute(rows, least, share):
    rows = [(k, t) for k, t in rows if t and t.strip()]
    counted = []
    for key, text in rows:
        words = [w for w in "".join(c if c.isalnum() or c == "_" else " " for c in text.lower()).split()
                 if len(w) > 1 and w not in STOP]
        counted.append((key, Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])))
    n, df = len(rows), Counter(t for _, c in counted for t in c)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items() if least <= d <= share * n}
    norm = defaultdict(float)
    for key, c in counted:
        for t, tf in c.items():
            norm[key] += (tf * idf.get(t, 0.0)) ** 2
    return [(k, t, tf, tf * idf[t] / math.sqrt(norm[k])) for k, c in counted for t, tf in c.items() if t in idf]


def canonical(rows):
    return sorted(((k, t, tf, round(w, 9)) for k, t, tf, w in rows), key=repr)


@pytest.mark.parametrize("size", [1, 400, 1 << 20])
def test_weights_equal_brute_force(spark, monkeypatch, size):
    """Blocks of one document, of some, of all; buckets of few terms; keys that repeat share a norm."""
    monkeypatch.setattr(term_blocks, "BLOCK_BYTES", size)
    monkeypatch.setattr(term_blocks, "BUCKET_BYTES", 1000)
    df = corpus(spark)
    got = topics.tfidf(df, "t", "id", STOP, min_docs=4, max_share=0.6)
    assert got.columns == ["id", "term", "tf", "weight"]
    want = canonical(brute([tuple(r) for r in df.collect()], 4, 0.6))
    assert len(want) > 100 and canonical(tuple(r) for r in got.collect()) == want


def test_texts_without_terms(spark):
    df = spark.createDataFrame([("a", "?!"), ("b", "the"), (None, None)], "id string, t string")
    assert topics.tfidf(df, "t", "id", STOP, min_docs=1).collect() == []
    assert topics.tfidf(df.limit(0), "t", "id", STOP).collect() == []
    assert topics.inferred_topics(df, "t", "id", STOP, min_docs=1) == []


@pytest.mark.parametrize("call", ["tfidf", "inferred_topics"])
def test_postings_are_not_written(spark, monkeypatch, call):
    """What is staged is a few blocks and answers, not one row for each term of a document."""
    staged, write = [], topics.stage

    def counting(df, *by):
        out = write(df, *by)
        staged.append(out.count())
        return out

    monkeypatch.setattr(topics, "stage", counting)
    texts = [" ".join(f"w{(i * 7 + j * j) % 900}ord" for j in range(60)) for i in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").repartition(2)
    found = getattr(topics, call)(df, "t", "id", [], min_docs=2)
    assert (found if call == "inferred_topics" else found.count() > 10_000) and staged[0] <= 2
    assert sum(staged) < 10_000   # terms of documents: about 59,000


@pytest.mark.parametrize("first", [1, 5, 10**9])
def test_topics_do_not_depend_on_the_terms_scored_first(spark, monkeypatch, first):
    """A term left out by its document frequency is scored as soon as it may be wanted."""
    draw = random.Random(5)
    texts = []
    for _ in range(200):
        often = draw.choices(range(40), weights=[1 / (i + 1) for i in range(40)], k=draw.randrange(1, 30))
        texts.append(" ".join(f"topic{i:02d}x" for i in often))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    whole = topics.inferred_topics(df, "t", "id", [], 20, [], min_docs=2)
    sums = Counter()
    for _, term, _, w in brute(list(enumerate(texts)), 2, 0.85):
        sums[term] += w
    ranked = sorted(sums, key=lambda t: (-round(sums[t], 6), t))
    want = [t for t in ranked if sum(t in x for x in texts) <= 0.3 * len(texts)][:60]
    assert len(whole) == 60 and whole == want
    monkeypatch.setattr(topics, "SCORED_TERMS", first)
    monkeypatch.setattr(topics, "FIRST_TEST", 1)
    assert topics.inferred_topics(df, "t", "id", [], 20, [], min_docs=2) == want


def test_blocks_keep_keys_in_order(spark):
    df = spark.createDataFrame([(None, "a b"), (2, ""), (3, "c")], "id int, t string").coalesce(1)
    [row] = term_blocks.word_blocks(df, "id", df["t"]).collect()
    assert row["keys"] == [None, 2, 3] and row["bytes"] == 4
