import random

from pyspark.sql import functions as F

from voxtally.llm import language as L

from .samples import docs_table

SYLLABLES = {"aa": ["ka", "lo", "mi", "ne", "tu"], "bb": ["sch", "ein", "ung", "ver", "ä"], "cc": ["éo", "que", "eau", "tion", "ç"]}


def texts(seed, n, shortest=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = ["".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(rng.randint(shortest, 200))]
        out.append((i, rng.choice([str.upper, str, str.title])(" ".join(words)), lang))
    return out


def test_held_out_accuracy(spark):
    df = spark.createDataFrame(texts(1, 300), "doc_id long, text string, lang string").withColumn("score", F.lit("old"))
    held = L.fold(F.col("doc_id")) == 2
    model = L.learn_dictionaries(df.filter(~held), per_language=40)
    assert sorted(model) == ["aa", "bb", "cc"] and all(len(v) <= 40 * 600 * 4 for v in model.values())
    out = L.identify_language(df, model).collect()
    assert all(0 <= r.score <= 1 for r in out)
    tested = [r for r in out if __import__("zlib").crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(tested) > 40 and sum(r.lang_pred == r.lang for r in tested) >= 0.97 * len(tested)
    assert sum(r.rejected for r in out) <= 0.03 * len(out)


def test_undetermined_ties_and_columns(spark):
    df = docs_table(spark, [(1, None), (2, ""), (3, "12 ... 3"), (4, "ka lo mi"), (None, "ka lo mi"), (4, "ka lo mi")])
    out = L.identify_language(df, {"aa": b" ka lo mi ne tu ", "bb": b" schein verung "}, prefix="_")
    assert out.columns == [*df.columns, "_lang_pred", "_score", "_rejected"]
    got = sorted(((r.doc_id, r._lang_pred, r._rejected) for r in out.collect()), key=repr)
    assert got == sorted([(1, "und", True), (2, "und", True), (3, "und", True), (4, "aa", False), (4, "aa", False),
                          (None, "aa", False)], key=repr)
    same = L.identify_language(df, {"x": b"abc", "y": b"abc"}).filter("doc_id = 4").first()
    assert (same.lang_pred, same.score, same.rejected) == ("x", 0.0, False)
    long = L.identify_language(docs_table(spark, [(4, "ka lo mi " * 20)]), {"x": b"abc", "y": b"abc"}).first()
    assert (long.lang_pred, long.score, long.rejected) == ("x", 0.0, True)
    assert {r.lang_pred for r in L.identify_language(df, {}).collect()} == {"und"}
    assert {r.lang_pred for r in L.identify_language(df, {"z": b"q"}).filter("doc_id = 4").collect()} == {"z"}
    assert L.identify_language(docs_table(spark, []), {"x": b"abc"}).collect() == []
    assert L.learn_dictionaries(df.withColumn("lang", F.lit(None).cast("string"))) == {}


def test_whole_text_counts(spark):
    rng = random.Random(2)
    word = lambda lang: "".join(rng.choices(SYLLABLES[lang], k=3))
    mixed = " ".join([word("aa") for _ in range(400)] + [word("cc") for _ in range(4000)])
    df = spark.createDataFrame(texts(3, 200), "doc_id long, text string, lang string")
    model = L.learn_dictionaries(df)
    assert L.identify_language(docs_table(spark, [(1, mixed)]), model).first().lang_pred == "cc"
