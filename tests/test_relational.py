import pytest
from pyspark.sql import functions as F

from voxtally.functions import phrases as P
from voxtally.functions.text import run_ngrams
from voxtally.operators import cleaning, ids, keyphrases, quality, reshape, sentiment, summary
from voxtally.operators import matching, reports, topics


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_unpivot_ids(spark):
    wide = spark.createDataFrame(
        [(0, "a", None, None, "x"), (1, " ", "d", None, "x"), (2, "c", None, None, "x")],
        "row int, Q1 string, `Q.2` string, Q3 string, `Sheet  Name` string")
    long = reshape.unpivot_long(wide, ["row"])
    got = ids.response_ids(long, "col_pos", "row").select("response_id", "question_text", "response_text")
    assert rows(got, "response_id") == [(1, "Q1", "a"), (2, "Q1", "c"), (3, "Q.2", "d")]


@pytest.mark.parametrize("limit", [10_000, 0])
def test_first_seen(spark, monkeypatch, limit):
    """Few values are ranked here, many by a range sort: same ids."""
    monkeypatch.setattr(ids, "bounded_rows", lambda df: __import__(
        "voxtally.session", fromlist=["x"]).bounded_rows(df, limit))
    df = spark.createDataFrame([(1, "B"), (2, "A"), (3, "B"), (4, None)], "id int, q string")
    got = ids.first_seen_ids(df.filter("q is not null"), "q", "id", "qid")
    assert rows(got.select("id", "qid"), "id") == [(1, 1), (2, 2), (3, 1)]


@pytest.mark.parametrize("parts", [1, 7])
def test_dense_index_within_groups(spark, parts):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"))
    got = ids.dense_index(df.repartition(parts), "id", out="n", within="g")
    expected = {"hot": 0, "cold": 0}
    for i, g, n in rows(got.select("id", "g", "n"), "id"):
        expected[g] += 1
        assert n == expected[g]


def test_sheet_exclusion(spark):
    df = spark.createDataFrame([("Keywords 2",), ("keywords",), ("Survey",)], "sheet_name string")
    assert rows(reshape.exclude_sheets(df), "sheet_name") == [("Survey",)]
    assert rows(reshape.exclude_sheets_exact(df), "sheet_name") == [("Keywords 2",), ("Survey",)]


def test_text_columns(spark):
    df = spark.createDataFrame([(1, "5", None, "z", "q")],
                               "id int, num string, nul string, txt string, TimeStamp string")
    assert reshape.text_columns(df) == ["txt"]


def test_combine(spark):
    df = spark.createDataFrame([(" a ", "NaN", None, "b")], "x string, y string, z string, w string")
    assert df.select(reshape.combine_row_text(df.columns)).first()[0] == "a b"


def test_preprocess_lemma_table_joined_equals_inline(spark, monkeypatch):
    df = spark.createDataFrame([(1, "Cats", "the cats and mice, cats"), (2, "Dogs?", None)],
                               "response_id int, question_text string, response_text string")
    lemmas = spark.createDataFrame([("cats", "cat"), ("mice", "mouse")], "word string, lemma string")
    inline = rows(cleaning.preprocess(df, ["the"], lemmas), "response_id")
    monkeypatch.setattr(cleaning, "INLINE_LIMIT", 1)
    joined = rows(cleaning.preprocess(df, ["the"], lemmas), "response_id")
    assert inline == joined
    assert inline[0][2] == "cat and mouse cat"


def test_wordset_sentiment(spark):
    df = spark.createDataFrame([(1, "good good bad"), (2, "good love bad"), (3, "good bad"), (4, None)],
                               "response_id int, response_text_original string")
    got = sentiment.add_wordset_sentiment(df).select("response_id", "sentiment_score", "sentiment_label")
    assert rows(got, "response_id") == [(1, 0.0, "neutral"), (2, 0.5, "positive"), (3, 0.0, "neutral"),
                                        (4, 0.0, "neutral")]


def test_labels(spark):
    df = spark.createDataFrame([(0.05,), (-0.05,), (0.049,)], "s double")
    assert [r[0] for r in df.select(sentiment.label_of(F.col("s"))).collect()] == [
        "positive", "negative", "neutral"]


LEXICON = {"good": 1.9, "bad": -2.5, "great": 3.1, "no": -1.2, "ass": -2.5}
CASES = {
    "good": 1.9, "": 0.0, "very good": 1.9 + 0.293, "not good": 1.9 * -0.74,
    "good but bad": 1.9 * 0.5 - 2.5 * 1.5, "GOOD day": 1.9 + 0.733, "GOOD": 1.9,
    "not a very good": (1.9 + 0.293) * -0.74, "xx yy never so good": (1.9 + 0.293) * 1.25,
    "at least good": 1.9, "tiny least good": 1.9 * -0.74, "good!!": 1.9 + 0.584, "no good": 1.9 * -0.74,
    "what a right bad ass": 1.5 + 1.5, "good, good.": 3.8, "is this slightly bad": -2.5 + 0.293,
}


def compound(total):
    return round(total / (total * total + 15) ** 0.5, 4)


@pytest.mark.parametrize("limit", [10_000, 0])
def test_lexicon_rules(spark, monkeypatch, limit):
    from voxtally import session
    monkeypatch.setattr(sentiment, "bounded_rows", lambda df: session.bounded_rows(df, limit))
    table = spark.createDataFrame(list(LEXICON.items()), "term string, valence double")
    df = spark.createDataFrame(list(enumerate(CASES)), "response_id int, t string")
    got = sentiment.add_lexicon_sentiment(df, table, "t").select("t", "sentiment_score").collect()
    for text, score in got:
        total = CASES[text]
        assert score == compound(total), (text, score)


def enriched(spark):
    return spark.createDataFrame(
        [(1, 1, 1, "Q one", "s2", 20, 2, 0.5, "positive", [("a", 2), ("b", 1)]),
         (2, 1, 1, "Q one", "s1", 30, 3, -0.5, "negative", [("b", 1)]),
         (3, 1, 1, "Q one", "s2", 25, 4, 0.0, "neutral", []),
         (4, 2, 2, "Q two", "s1", 3, 1, 0.0, "neutral", [])],
        "response_id int, survey_id int, question_id int, question_text_original string, sheet_name string, "
        "response_length int, word_count int, sentiment_score double, sentiment_label string, "
        "keywords array<struct<keyword:string,count:int>>")


def test_summary(spark):
    got = [tuple(r) for r in summary.summary_by_question(enriched(spark)).collect()]
    assert got == [
        (1, "Q one", 3, 25.0, 3.0, 0.0, 0.5, 1, 1, 1, "s2, s1", "a", 2),
        (1, "Q one", 3, 25.0, 3.0, 0.0, 0.5, 1, 1, 1, "s2, s1", "b", 2),
        (2, "Q two", 1, 3.0, 1.0, 0.0, None, 0, 0, 1, "s1", "", 0)]


def test_instances(spark, monkeypatch):
    pool = spark.createDataFrame([("x", 2), ("y", 1), ("z", 25)], "keyword string, frequency long")
    got = rows(summary.instances(pool, "keyword").groupBy("keyword").count(), "keyword")
    assert got == [("x", 2), ("y", 1), ("z", 25)]
    monkeypatch.setattr(summary, "INSTANCE_CHUNK", 10)
    assert rows(summary.instances(pool, "keyword").groupBy("keyword").count(), "keyword") == got
    assert summary.instances(pool, "keyword", limit=1).count() == 25


def test_pool(spark):
    totals = spark.createDataFrame([("Data", 3, (2, 0)), ("later", 3, (5, 1))],
                                   "keyword string, frequency long, first_seen struct<_row:long,_rank:int>")
    vocab = spark.createDataFrame([("data", 9, 0), ("job", 3, 2), ("ant", 3, 1)],
                                  "keyword string, doc_freq long, pos int")
    pool = summary.keyword_pool(totals, vocab)
    ordered = pool.orderBy(F.desc("frequency"), *summary.POOL_ORDER).select("keyword").collect()
    assert [r[0] for r in ordered] == ["Data", "later", "ant", "job"]


def hot_rows(spark):
    """A third of all rows hold one text, in one question and sheet."""
    return spark.range(900).select(
        F.col("id").alias("response_id"),
        F.when(F.col("id") % 3 == 0, "hot topic, shared words and more")
        .otherwise(F.concat(F.lit("topic "), F.col("id") % 7, F.lit(" is data"))).alias("response_text_original"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("q"), F.col("id") % 5)).alias("question"))


@pytest.mark.parametrize("parts", [1, 13])
def test_hot_group(spark, parts):
    stop, words = ["is", "and"], ["topic", "shared words", "data"]
    df = keyphrases.add_keywords(hot_rows(spark).repartition(parts), stop, words)
    totals = {r["keyword"]: r["frequency"] for r in summary.keyword_totals(df, []).collect()}
    assert totals["shared words"] == 600 and totals["topic"] == 900
    best = summary.top_keywords(summary.keyword_totals(df, ["question"]), ["question"], 2)
    assert best.filter("question = 'hot'").count() == 2
    memo = keyphrases.per_distinct_text(hot_rows(spark), "response_text_original", "bag",
                                        lambda t: P.top_phrases(t, stop, []))
    plain = hot_rows(spark).withColumn("bag", P.top_phrases(F.col("response_text_original"), stop, []))
    assert rows(memo.select("response_id", "bag"), "response_id") == rows(
        plain.select("response_id", "bag"), "response_id")
    assigned = topics.assign_topics(hot_rows(spark), words, "response_text_original", "response_id")
    matrix = topics.topic_matrix(assigned.repartition(parts), words, "response_id")
    column = [r["topic"] for r in matrix.orderBy("row_no").collect()]
    assert column == [str(i) for i in range(900)]


def test_meaningful(spark):
    assert rows(summary.meaningful_questions(enriched(spark)).select("response_id"), "response_id") == [
        (1,), (2,), (3,)]


def test_distribution_and_profile(spark):
    assert rows(summary.label_distribution(enriched(spark)), "sentiment_label") == [
        ("negative", 1, 25.0), ("neutral", 2, 50.0), ("positive", 1, 25.0)]
    assert summary.run_profile(enriched(spark)).first()["with_keywords"] == 2


def test_matches_joined_equals_inline(spark, monkeypatch):
    words = ["Data", "c++", "of the", "a b c d e f", "??", "a", "x.y", "b c"]
    texts = ["data of  the", "c++x a b c d e f", "what??no x.y", "a b c d e", "of the a", "use c++", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "response_id int, t string")
    inline = rows(matching.with_matches(df, words, "t", "m"), "response_id")
    spelled = rows(matching.with_matches(df, words, "t", "m", spelled=True), "response_id")
    monkeypatch.setattr(matching, "INLINE_LIMIT", 2)
    assert rows(matching.with_matches(df, words, "t", "m"), "response_id") == inline
    assert rows(matching.with_matches(df, words, "t", "m", spelled=True), "response_id") == spelled
    assert inline[1][2] == ["c++", "a b c d e f", "a", "b c"]
    assert spelled[0][2] == ["Data"]
    joined = matching.document_frequency(df, words, "t", "response_id").select("keyword", "doc_freq", "pos")
    assert ("??", 1, 4) in rows(joined, "keyword")
    monkeypatch.undo()
    listed = matching.document_frequency(df, words, "t", "response_id").select("keyword", "doc_freq", "pos")
    assert rows(listed, "keyword") == rows(joined, "keyword")


@pytest.mark.parametrize("limit", [10_000, 12, 6, 0])
def test_ngrams_are_made_where_keywords_can_stand(spark, monkeypatch, limit):
    """Beginnings of 1 to 7 runs, of fewer or none are listed: same matches, and listed ones make no other n-gram."""
    words = ["a b c d e f g", "a b x", "b", "c++", "a b c d e f", "g h", "a b x"]
    texts = ["a b c d e f g h", "a a a b a a b a x", "a b x c++", "c++ a b c d e g", "", None, "z z z"]
    df = spark.createDataFrame(list(enumerate(texts)), "response_id int, t string")
    want = rows(matching.matches(df, words, "t", "response_id"), "response_id", "keyword")
    assert len(want) == 8
    monkeypatch.setattr(matching, "INLINE_LIMIT", limit)
    found = matching.matches_joined(df, words, "t", "response_id").select("response_id", "keyword")
    assert rows(found, "response_id", "keyword") == want
    listed = matching.listed_prefixes(spark.createDataFrame(
        [("a b c d", 7), ("a b x", 5), ("b", 1), ("c++", 2)], "span string, size int"))
    assert sorted(listed) == {10_000: [1, 2, 3, 4, 5, 6, 7], 12: [1, 2, 3, 4, 5, 6, 7], 6: [1, 2, 3], 0: []}[limit]
    if limit >= 12:
        made = df.select("response_id", F.explode(run_ngrams(F.col("t"), [1, 2, 5, 7], listed)["span"]).alias("s"))
        assert rows(made.distinct(), "response_id", "s") == [
            (0, "a b c d"), (0, "b"), (1, "b"), (2, "a b x"), (2, "b"), (2, "c++"), (3, "a b c d"), (3, "b")]


SCHEMA = ("survey_id int, question_id int, question_text string, response_id int, response_text string, "
          "Timestamp string, email string")


def test_validation(spark):
    df = spark.createDataFrame([(1, 1, None, 1, None, "2024-01-01", "e"), (1, 1, "q", 2, " ", "2024-01-02", None),
                                (1, 1, "q", 3, "x", None, None)], SCHEMA)
    result = quality.validate(df)
    assert result.passed
    assert sorted(map(tuple, result.report.collect())) == [
        ("coverage", "email", "info", 1), ("empty", "response_text", "warn", 1),
        ("missing", "question_text", "warn", 1), ("missing", "response_text", "warn", 1)]
    assert dict(result.converted.dtypes)["Timestamp"] == "timestamp"
    assert dict(df.dtypes)["Timestamp"] == "string"


def test_validation_fails(spark):
    bad = spark.createDataFrame([(1, 1, "q", 1, "x", "garbage", "e")], SCHEMA)
    assert not quality.validate(bad).passed
    assert not quality.validate(bad.drop("survey_id", "Timestamp")).passed
    texty = bad.withColumn("survey_id", F.lit("s1")).withColumn("Timestamp", F.lit("2024-01-01"))
    assert not quality.validate(texty).passed
    floats = bad.withColumn("survey_id", F.lit(1.5)).withColumn("Timestamp", F.lit("2024-01-01"))
    assert quality.validate(floats).passed


def test_reports(spark):
    df = enriched(spark).withColumn("topics", F.array(F.lit("T")))
    assert rows(reports.sentiment_histogram(df), "bucket") == [(-0.5, 1), (0.0, 2), (0.5, 1)]
    assert reports.response_detail(df, 1, "negative").count() == 1
    assert reports.filter_responses(df, sheet="s1", topic="T", question_contains="ONE").count() == 1
    assert reports.filter_responses(df, keyword="b").count() == 2
    ranked = reports.questions_by_sentiment(summary.question_stats(df))
    assert rows(ranked.select("question_id", "rank"), "question_id") == [(1, 1), (2, 1)]


def test_tables_with_repeats_nulls_and_case(spark, monkeypatch):
    """Short tables are inlined and long ones joined: the rows are the same."""
    df = spark.createDataFrame([(1, "Q cats", "cats DOGS geese"), (2, "Q", "good bad Good"), (3, None, None)],
                               "response_id long, question_text string, response_text string")
    lemmas = spark.createDataFrame([("cats", "cat"), ("cats", "katze"), ("dogs", None), (None, "x"), ("geese", "goose")],
                                   "word string, lemma string")
    words = spark.createDataFrame([(0, None), (1, " Cats "), (2, "cats"), (3, ""), (4, "GEESE"), (5, "\u00a0dogs")],
                                  "pos long, keyword string")
    lexicon = spark.createDataFrame([("good", 2.0), ("good", 1.0), ("bad", -3.0), (None, 1.0), ("cats", None)],
                                    "term string, valence double")

    def run():
        cleaned = rows(cleaning.preprocess(df, ["q"], lemmas), "response_id")
        found = rows(matching.with_matches(df, words, "response_text", "m", spelled=True), "response_id")
        scored = rows(sentiment.add_lexicon_sentiment(df, lexicon, "response_text"), "response_id")
        return cleaned, found, scored

    inline = run()
    for module in (cleaning, matching, sentiment):
        monkeypatch.setattr(module, "bounded_rows", lambda *_: None)
    assert run() == inline
    assert inline[0][0][2] == "cat dogs goose" and inline[1][0][3] == [" Cats ", "GEESE", "\u00a0dogs"]
