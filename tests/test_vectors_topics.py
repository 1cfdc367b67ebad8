import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtally.operators import topics, vectors


def vocab(spark):
    return spark.createDataFrame([(0, "x", [1.0, 0.0]), (1, "y", [0.0, 2.0]), (2, "x2", [1.0, 0.0])],
                                 "pos int, keyword string, vec array<float>")


def items(spark):
    return spark.createDataFrame([(1, [2.0, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [-1.0, -1.0])],
                                 "id int, vec array<float>")


@pytest.mark.parametrize("cells", [vectors.MATRIX_CELLS, 0])
def test_best_match(spark, monkeypatch, cells):
    monkeypatch.setattr(vectors, "MATRIX_CELLS", cells)
    got = {r["id"]: (round(r["similarity"], 4), r["closest"])
           for r in vectors.best_match(items(spark), "id", "vec", vocab(spark)).collect()}
    assert got[2] == (1.0, "y") and got[3] == (0.0, "") and got[1][1] == "x" and got[4][1] == "x"


def test_blocked_equals_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(1)
    left = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(60)], "id int, vec array<double>")
    right = spark.createDataFrame([(i, f"k{i}", rng.normal(size=6).tolist()) for i in range(25)],
                                  "pos int, keyword string, vec array<double>")
    def run():
        return sorted((r[0], round(r[1], 9), r[2]) for r in vectors.best_match(left, "id", "vec", right).collect())
    direct = run()
    monkeypatch.setattr(vectors, "MATRIX_CELLS", 1)
    assert run() == direct and len(direct) == 60


def test_similar(spark):
    kept = vectors.similar_to(items(spark), "id", "vec", vocab(spark), 0.35)
    assert sorted(r["id"] for r in kept.collect()) == [1, 2]
    everything = vectors.similar_to(items(spark), "id", "vec", vocab(spark).limit(0))
    assert everything.count() == 4


def test_mean_vectors(spark):
    words = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 3.0])], "word string, vec array<float>")
    df = spark.createDataFrame([("A b",), ("zz",), ("a a q",)], "t string")
    got = {r["t"]: r["vec"] for r in vectors.mean_vectors(df, "t", "t", words).collect()}
    assert got["zz"] is None
    assert got["A b"] == pytest.approx([math.sqrt(0.5)] * 2, abs=1e-6)
    assert got["a a q"] == pytest.approx([1.0, 0.0], abs=1e-6)
    zero = {r["t"]: r["vec"] for r in vectors.mean_vectors(df, "t", "t", words, missing_as_zero=True).collect()}
    assert zero["zz"] == [0.0, 0.0]


def test_vectors_are_not_cut(spark):
    words = spark.createDataFrame([("a", [0.0] * 149 + [2.0])], "word string, vec array<float>")
    df = spark.createDataFrame([("a a",)], "t string")
    assert vectors.mean_vectors(df, "t", "t", words).first()["vec"] == pytest.approx([0.0] * 149 + [1.0])
    mixed = words.union(spark.createDataFrame([("b", [1.0])], "word string, vec array<float>"))
    with pytest.raises(ValueError):
        vectors.mean_vectors(df, "t", "t", mixed)


def test_blocks_move_no_vectors(spark, monkeypatch, capsys):
    monkeypatch.setattr(vectors, "MATRIX_CELLS", 2)
    vectors.best_match(items(spark), "id", "vec", vocab(spark)).explain()
    exchanges = [line for line in capsys.readouterr().out.splitlines() if "Exchange" in line]
    assert len(exchanges) == 1 and "hashpartitioning(id" in exchanges[0]


def test_embed(spark):
    def load():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])
    df = spark.createDataFrame([("aaa",), (None,)], "t string")
    got = [r["v"] for r in vectors.embed(df, "t", "v", load).collect()]
    assert got[0] == pytest.approx([3 / math.sqrt(10), 1 / math.sqrt(10)], abs=1e-6)


def corpus(spark):
    texts = [f"remote working patterns matter {i}" for i in range(12)] + ["jobs"] * 3 + [
        "other answers follow here 12345"] * 45 + [" ", None]
    return spark.createDataFrame(list(enumerate(texts)), "response_id int, t string")


def brute_topics(texts, stop, n_topics):
    import re
    texts = [t for t in texts if t and t.strip()]
    docs = []
    for t in texts:
        tokens = [w for w in re.findall(r"\w\w+", t.lower()) if w not in stop]
        docs.append(tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])])
    df, n = {}, len(texts)
    for d in docs:
        for w in set(d):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((1 + n) / (1 + c)) + 1 for w, c in df.items() if 10 <= c <= 0.85 * n}
    score = {}
    for d in docs:
        w = {t: d.count(t) * idf[t] for t in set(d) if t in idf}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            score[t] = score.get(t, 0) + v / norm
    ranked = sorted(score, key=lambda t: (-round(score[t], 6), t))
    return [t for t in ranked if len(t) >= 5 and t not in stop and not t.replace(" ", "").isdigit()
            and sum(t in x.lower() for x in texts) <= 0.3 * n][:3 * n_topics]


def test_inferred_topics(spark):
    df = corpus(spark)
    texts = [r["t"] for r in df.collect()]
    got = topics.inferred_topics(df, "t", "response_id", ["here"], 3, [])
    assert got == brute_topics(texts, {"here"}, 3)
    assert "remote working" in got and "other" not in got and "12345" not in got and "jobs" not in got


def test_inferred_topics_batches(spark, monkeypatch):
    """Testing candidates in small batches gives the same list."""
    df = corpus(spark)
    whole = topics.inferred_topics(df, "t", "response_id", [], 1, [])
    monkeypatch.setattr(topics, "FIRST_TEST", 1)
    monkeypatch.setattr(topics, "TERMS_PER_TOPIC", 3)
    assert topics.inferred_topics(df, "t", "response_id", [], 1, []) == whole


def test_degenerate(spark):
    df = corpus(spark)
    assert topics.inferred_topics(df.limit(1), "t", "response_id", []) == []
    assert topics.inferred_topics(df.limit(11), "t", "response_id", []) == []


def test_universe(spark):
    assert topics.topic_universe(["Data"], ["data", "jobs"]) == [(1, "Data", "provided"), (2, "jobs", "inferred")]
    a = spark.createDataFrame([(1, "Data")], "pos int, topic string")
    b = spark.createDataFrame([(1, "data"), (2, "jobs")], "pos int, topic string")
    got = [tuple(r) for r in topics.topic_universe_table(a, b).orderBy("pos").collect()]
    assert got == [(1, "Data", "provided"), (2, "jobs", "inferred")]


def test_topic_matrix(spark):
    df = spark.createDataFrame([(1, "T1 here"), (2, "t1 and t2"), (3, "none")], "response_id int, t string")
    assigned = topics.assign_topics(df, ["T1", "t2", "t3"], "t", "response_id")
    matrix = topics.topic_matrix(assigned, ["T1", "t2", "t3"], "response_id")
    assert matrix.columns == ["row_no", "T1", "t2"]
    assert [tuple(r)[1:] for r in matrix.orderBy("row_no").collect()] == [("1", "2"), ("2", "")]
    counts = {r[0]: r[1] for r in topics.topic_counts(assigned).collect()}
    assert counts == {"T1": 2, "t2": 1}
    cells = sum(v != "" for r in matrix.drop("row_no").collect() for v in r)
    assert cells == sum(counts.values())


def test_postings_count_terms_in_one_pass(spark):
    texts = ["Big data, big Data now", "one", "a b", "", None, "the big the data"]
    df = spark.createDataFrame(list(enumerate(texts)), "response_id int, t string")
    got = {}
    for r in topics.postings(df, "t", "response_id", ["the"]).collect():
        got.setdefault(r["response_id"], {})[r["term"]] = r["tf"]
    assert got == {0: {"big": 2, "data": 2, "now": 1, "big data": 2, "data big": 1, "data now": 1},
                   1: {"one": 1}, 5: {"big": 1, "data": 1, "big data": 1}}
    counted = df.select(topics.term_counts(F.array_join(topics.words(F.col("t"), ["the"]), " ")).alias("n"))
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "sort_array" not in plan


def test_weights_of_a_large_vocabulary_equal_those_of_a_small_one(spark, monkeypatch):
    """Beyond the limit the vocabulary is hashed in shares; only counts cross the exchange by document."""
    texts = [" ".join(["alpha"] * (i % 3 + 1) + [f"word{i % 4}", "beta"]) for i in range(24)] + [None, ""]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "response_id int, t string")   # keys repeat
    whole = lambda: topics.tfidf(df, "t", "response_id", [], min_docs=2, max_share=1.0)
    rows = lambda d: sorted((r[0], r[1], r[2], round(r[3], 9)) for r in d.collect())
    small = rows(whole())
    monkeypatch.setattr(topics, "BROADCAST_TERMS", 1)
    large = whole()
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert small and rows(large) == small
    assert "ShuffledHashJoin" in plan and plan.count("_w") and "_w" not in plan[plan.index("REPARTITION_BY_COL"):]
