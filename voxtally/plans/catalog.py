"""Checked queries over the test tables: one per operator.

``documents`` stands for the response table: text is the answer, lang the
question, source the sheet. Each query takes ``(spark, folder)`` and reads the
whole tables.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import phrases as P
from ..functions import text as X
from ..functions import wordlists as L
from ..functions.arrays import explode_rows
from ..operators import (cleaning, ids, keyphrases, lemmas, matching, quality, reports, reshape, sentiment,
                         summary, topics, vectors)
from ..session import shared_dir, small_table, spread, stage
from ..sources import csv_folder, csv_split, vocabulary, wide_variant, workbook_source
from ..sources.files import list_files
from ..sources.sink import write_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters shared with the reference SQL.
VOCABULARY = ("thing", "The", "of the", "de la", "on", "la", "c++", "é", "nicht", "worthless",
              "of", "data science", "e.g", "être", "und", "the and")
PROVIDED_TOPICS = ("Thing", "of the", "de la", "nicht", "data science", "que")
CUSTOM_POSITIVE = ("thing", "que", "und")
CUSTOM_NEGATIVE = ("nicht", "the", "los")
LEMMAS = {"thing": "think", "eau": "water", "es": "e", "ouan": "oua", "tionen": "tion", "les": "le"}
LEXICON = (("thing", 1.9), ("the", 0.4), ("of", -0.7), ("que", 1.5), ("la", -1.1), ("nicht", -2.3),
           ("und", 0.8), ("no", -1.2), ("los", 2.1), ("be", 0.9))
# Degree words and negations that occur in the texts, so that each rule applies.
RULES = {
    "boosters": ("and", "les", "more", "very"), "dampeners": ("in", "des", "to be"),
    "negations": ("is", "le", "not", "el"),
    "idioms": {"of the": 1.4, "the and": -2.0, "de la": 0.3},
}
EXCLUDED_SHEETS = ("SRC1", "src2")
PHRASES_COUNTED = ("the", "ion", "aa", "of the", "é")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """documents in the shape of the long response table."""
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("response_id"), F.col("text").alias("response_text"),
        F.col("lang").alias("question_text"), F.col("source").alias("sheet_name"))
    return spread(docs, "response_id")


STOP = L.ENGLISH_STOP_WORDS


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.preprocess(responses(spark, folder), STOP)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return sentiment.add_wordset_sentiment(cleaned(spark, folder), positive=CUSTOM_POSITIVE,
                                           negative=CUSTOM_NEGATIVE)


def with_bags(spark: SparkSession, folder: str) -> DataFrame:
    return keyphrases.add_keywords(scored(spark, folder), STOP, VOCABULARY)


def with_ids(df: DataFrame) -> DataFrame:
    df = ids.first_seen_ids(df, "question_text_original", "response_id", "question_id")
    return ids.first_seen_ids(df, "sheet_name", "response_id", "survey_id")


def enriched(spark: SparkSession, folder: str) -> DataFrame:
    """Bags and ids, written once because several aggregates read them."""
    return with_ids(stage(with_bags(spark, folder).drop("response_text", "question_text")))


# --- sources, reshape, ids ----------------------------------------------------


@query
def scan_csv_long(spark, folder):
    out = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    docs = table(spark, folder, "documents").select(
        F.col("text").alias("Your answer, please"), F.col("lang").alias("lang"),
        F.col("source").alias("Sheet  Name"))
    docs.write.option("header", True).option("quote", '"').option("escape", '"').csv(out)
    cells = csv_folder.scan_csv_long(spark, out)
    return cells.groupBy("question_text", "response_text").agg(F.count("*").alias("n"))


@query
def csv_sink(spark, folder):
    """Documents written as CSV and read back, line breaks and quotes included."""
    out = f"{shared_dir(spark)}/sink-{uuid.uuid4().hex}"
    path = write_csv(table(spark, folder, "documents").select("doc_id", "text", "lang"), out, "documents.csv")
    return csv_folder.read_table(spark, path).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")


BLOCK_BYTES = 64 * 1024      # blocks of the split CSV queries: many per file at every size


@query
def scan_csv_split(spark, folder):
    """``scan_csv_long`` with files cut into blocks of 64 KB, records found by quote parity."""
    out = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    docs = table(spark, folder, "documents").select(
        F.col("text").alias("Your answer, please"), F.col("lang").alias("lang"),
        F.col("source").alias("Sheet  Name"))
    docs.write.option("header", True).option("quote", '"').option("escape", '"').csv(out)
    cells = csv_folder.scan_csv_long(spark, out, block_bytes=BLOCK_BYTES)
    return cells.groupBy("question_text", "response_text").agg(F.count("*").alias("n"))


@query
def csv_one_file_split(spark, folder):
    """All documents in one CSV file, line breaks in quotes, read back in blocks of 64 KB by many tasks."""
    out = f"{shared_dir(spark)}/one-{uuid.uuid4().hex}"
    path = write_csv(table(spark, folder, "documents").select("doc_id", "text", "lang"), out, "documents.csv",
                     single_file=True)
    rows = csv_split.read_csv_split(spark, list_files(spark, path, "csv"), ["doc_id", "text", "lang"], block_bytes=BLOCK_BYTES)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")


@query
def workbook_by_sheet(spark, folder):
    """``part``, ``supplier`` and ``documents`` (without text) written as workbooks of 100-row sheets, read back
    sheet by sheet, many to a task, as
    ``(tbl, key, header, value)`` for every cell beside the key column."""
    out = f"{shared_dir(spark)}/books-{uuid.uuid4().hex}"
    written = {
        "part": table(spark, folder, "part").select(
            F.col("p_partkey").cast("string").alias("p_partkey"), "p_name", "p_brand", "p_type",
            F.col("p_size").cast("string").alias("p_size")),
        "supplier": table(spark, folder, "supplier").select(
            F.col("s_suppkey").cast("string").alias("s_suppkey"), "s_name",
            F.col("s_nationkey").cast("string").alias("s_nationkey")),
        "documents": table(spark, folder, "documents").select(
            F.col("doc_id").cast("string").alias("doc_id"), "lang", "source",
            F.col("n_chars").cast("string").alias("n_chars")),
    }
    found = []
    for name, df in written.items():
        workbook_source.write_workbooks(df, f"{out}/{name}", rows_per_sheet=100).collect()
        cells = workbook_source.read_sheets(spark, f"{out}/{name}").filter("error IS NULL AND row_pos > 0")
        # a row's cells meet its key cell by one shuffle, so that the sheets are parsed once
        row = W.partitionBy("source_file", "sheet_pos", "row_pos")
        key = F.max(F.when(F.col("col_pos") == 0, F.col("value"))).over(row)
        found.append(cells.select("col_pos", "header", "value", key.alias("key"))
                     .filter("col_pos > 0 AND key IS NOT NULL")
                     .select(F.lit(name).alias("tbl"), "key", "header", "value"))
    return reduce(DataFrame.unionByName, found)


WIDE_FILES = 2000      # files of the wide load, half with each header


@query
def wide_variant_load(spark, folder):
    """``documents`` as 2,000 small CSV files of two headers, loaded as one table through VARIANT rows."""
    out = f"{shared_dir(spark)}/wide-{uuid.uuid4().hex}"
    docs = table(spark, folder, "documents")
    for parity, extra in ((0, "lang"), (1, "source")):
        part = docs.filter(F.col("doc_id") % 2 == parity).select("doc_id", "text", extra)
        part.repartition(WIDE_FILES // 2, "doc_id").write.option("header", True).option("quote", '"') \
            .option("escape", '"').csv(f"{out}/{extra}")
    paths = list_files(spark, f"{out}/lang", "csv") + list_files(spark, f"{out}/source", "csv")
    wide = wide_variant.load_wide_variant(spark, paths)
    return wide.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")


# Known lemmas beside those taken from the text, and irregular forms (form, order, lemma): parameters of noun_lemmas.
NOUN_INDEX = ("mouse", "goose", "child", "glass", "box", "church", "wife", "city", "man", "bus", "wish", "quiz")
NOUN_EXCEPTIONS = (("mice", 0, "mouse"), ("geese", 0, "goose"), ("children", 0, "child"), ("les", 0, "le"),
                   ("les", 1, "la"), ("des", 0, "de"))
ASCII_WORD = "[a-z]+"


@query
def noun_lemmas(spark, folder):
    """Every distinct word of ``documents`` with its noun lemma by rule and its count. The index holds the
    listed lemmas and every word of 3 or more occurrences that does not end in "s"."""
    words = table(spark, folder, "documents").select(F.explode(F.regexp_extract_all(
        F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase),
        F.lit(ASCII_WORD), F.lit(0))).alias("word"))
    counts = stage(words.groupBy("word").agg(F.count("*").alias("n")))
    index = counts.filter((F.col("n") >= 3) & ~F.col("word").endswith("s")).select(F.col("word").alias("lemma")) \
        .unionByName(small_table(spark, [(w,) for w in NOUN_INDEX], lemma=pa.string()))
    exceptions = small_table(spark, NOUN_EXCEPTIONS, form=pa.string(), pos=pa.int32(), lemma=pa.string())
    found = lemmas.noun_lemmas(counts, index, exceptions)
    return counts.join(found, "word").select("word", "lemma", "n")


@query
def unpivot_long(spark, folder):
    part = table(spark, folder, "part").select(
        "p_partkey", "p_name", "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"),
        F.col("p_retailprice").cast("string").alias("p_retailprice"), F.lit(" ").alias("blank"),
        F.lit(None).cast("string").alias("empty"), F.lit("x").alias("Sheet  name"))
    return reshape.unpivot_long(part, ["p_partkey"])


@query
def response_ids(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    long = reshape.unpivot_long(part, ["p_partkey"])
    return ids.response_ids(long, "col_pos", "p_partkey")


@query
def first_seen_ids(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    return ids.first_seen_ids(part, "p_name", "p_partkey", "question_id")


@query
def sheet_exclusion(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("sheet_name"))
    patterns = [p.lower() for p in EXCLUDED_SHEETS]
    return reshape.exclude_sheets(docs, patterns=patterns)


@query
def sheet_exclusion_exact(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("sheet_name"))
    return reshape.exclude_sheets_exact(docs, names=EXCLUDED_SHEETS)


@query
def wide_union(spark, folder):
    part = table(spark, folder, "part").select("p_name", "p_brand", "p_size")
    supplier = table(spark, folder, "supplier").select("s_name", "s_nationkey")
    return reshape.wide_union([reshape.with_sheet(part, "part"),
                               reshape.with_sheet(supplier, "supplier", first=False, fill="")])


@query
def detect_text_columns(spark, folder):
    return reshape.text_column_flags(table(spark, folder, "part"))


@query
def detect_text_columns_exact(spark, folder):
    """Excluded names by their exact case; NULL cells read as the word "nan"."""
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    return reshape.text_column_flags(docs.withColumnRenamed("source", "timestamp"),
                                     ("Timestamp", "lang", "sheet_name"), False, True)


@query
def combine_row_text(spark, folder):
    part = table(spark, folder, "part").withColumn(
        "p_type", F.when(F.col("p_size") > 25, F.col("p_type")).when(F.col("p_size") > 10, "NaN"))
    return part.select("p_partkey", reshape.combine_row_text(
        ["p_name", "p_type", "p_brand"]).alias("combined"))


@query
def meaningful_questions(spark, folder):
    talk = table(spark, folder, "conversations").select(
        F.concat_ws("#", "conv_id", "turn").alias("response_id"),
        F.concat_ws("-", "role", F.least("turn", F.lit(3))).alias("question_id"),
        F.length("text").alias("response_length"))
    return summary.meaningful_questions(talk, minimum=400)


# --- cleaning -----------------------------------------------------------------


@query
def clean_text(spark, folder):
    return responses(spark, folder).select(
        "response_id", X.clean_text(F.col("response_text")).alias("cleaned"))


@query
def tokenize(spark, folder):
    return explode_rows(responses(spark, folder), ["response_id"],
                        X.clean_tokens(F.col("response_text")), "token", "pos")


@query
def remove_stopwords(spark, folder):
    kept = X.drop_words(X.clean_tokens(F.col("response_text")), STOP)
    return responses(spark, folder).select(
        "response_id", F.array_join(kept, " ").alias("kept"), F.size(kept).alias("n_kept"))


@query
def lemmatize(spark, folder):
    return responses(spark, folder).select("response_id", X.clean_text(
        F.col("response_text"), STOP, LEMMAS).alias("lemmas"))


@query
def preprocess(spark, folder):
    return cleaning.preprocess(responses(spark, folder), STOP, LEMMAS)


@query
def preprocess_columns(spark, folder):
    return cleaning.preprocess_columns(table(spark, folder, "part"), STOP)


@query
def text_lengths(spark, folder):
    return responses(spark, folder).select(
        "response_id", F.length("response_text").alias("response_length"),
        X.word_count(X.clean_text(F.col("response_text"), STOP)).alias("word_count"))


@query
def phrase_counts(spark, folder):
    low = F.lower("response_text")
    return responses(spark, folder).select("response_id", *[
        X.substring_count(low, F.lit(p)).alias(f"n{i}") for i, p in enumerate(PHRASES_COUNTED)])


# --- sentiment ----------------------------------------------------------------


@query
def sentiment_wordset(spark, folder):
    df = sentiment.add_wordset_sentiment(responses(spark, folder), "response_text")
    return df.select("response_id", "sentiment_score", "sentiment_label")


@query
def sentiment_wordset_custom(spark, folder):
    df = sentiment.add_wordset_sentiment(responses(spark, folder), "response_text",
                                         CUSTOM_POSITIVE, CUSTOM_NEGATIVE)
    return df.select("response_id", "sentiment_score", "sentiment_label")


def lexicon_scored(spark, folder):
    return sentiment.add_lexicon_sentiment(responses(spark, folder), dict(LEXICON), "response_text",
                                           **RULES)


@query
def sentiment_lexicon(spark, folder):
    return lexicon_scored(spark, folder).select("response_id", "sentiment_score", "sentiment_label")


@query
def sentiment_lexicon_table(spark, folder):
    """The lexicon as a table with repeats and gaps: of equal terms the least valence counts."""
    rows = [*LEXICON, ("the", 3.0), ("la", 2.5), ("nowhere", None)]
    lexicon = small_table(spark, rows, term=pa.string(), valence=pa.float64())
    df = sentiment.add_lexicon_sentiment(responses(spark, folder), lexicon, "response_text", **RULES)
    return df.select("response_id", "sentiment_score", "sentiment_label")


@query
def sentiment_distribution(spark, folder):
    return summary.label_distribution(lexicon_scored(spark, folder))


@query
def sentiment_histogram(spark, folder):
    return reports.sentiment_histogram(lexicon_scored(spark, folder))


# --- key phrases ----------------------------------------------------------------


@query
def rake_candidates(spark, folder):
    return keyphrases.rake_candidates(responses(spark, folder), "response_text", "response_id",
                                      STOP)


@query
def rake_scores(spark, folder):
    return keyphrases.rake_scores(responses(spark, folder), "response_text", "response_id",
                                  STOP)


@query
def keyphrases_topk(spark, folder):
    df = keyphrases.add_keywords(responses(spark, folder), STOP, text="response_text")
    return keyphrases.bag_rows(df, "keywords", "response_id")


@query
def keyphrases_with_vocab(spark, folder):
    df = keyphrases.add_keywords(responses(spark, folder), STOP, VOCABULARY,
                                 text="response_text")
    return keyphrases.bag_rows(df, "keywords", "response_id")


@query
def keyphrases_memo(spark, folder):
    words, generic = STOP, L.GENERIC_WORDS
    df = keyphrases.per_distinct_text(responses(spark, folder), "response_text", "keywords",
                                      lambda t: P.top_phrases(t, words, generic))
    return keyphrases.bag_rows(df, "keywords", "response_id")


@query
def keyphrases_simple(spark, folder):
    docs = responses(spark, folder).withColumn("combined", reshape.combine_row_text(
        ["question_text", "response_text"]))
    return docs.select("response_id", F.array_join(
        P.top_phrases_simple(F.col("combined"), STOP), ", ").alias("keywords"))


@query
def frequent_tokens_topk(spark, folder):
    df = responses(spark, folder).withColumn("bag", P.frequent_tokens(
        F.col("response_text"), STOP, L.GENERIC_WORDS))
    return keyphrases.bag_rows(df, "bag", "response_id")


@query
def frequent_tokens_lemmas(spark, folder):
    df = keyphrases.frequent_keywords(responses(spark, folder), STOP, "response_text", lemmas=LEMMAS)
    return keyphrases.bag_rows(df, "keywords", "response_id")


@query
def frequent_tokens_similar(spark, folder):
    """Bags reduced to the words whose vector lies near a label's mean vector."""
    words, places = benchmark_vectors(spark, folder), stage(centroids(spark, folder))
    df = keyphrases.frequent_keywords(
        responses(spark, folder), STOP, "response_text",
        similar=lambda found: vectors.similar_to(
            vectors.mean_vectors(found, "keyword", "keyword", words), "keyword", "vec", places))
    return keyphrases.bag_rows(df, "keywords", "response_id")


@query
def keyword_json_roundtrip(spark, folder):
    df = keyphrases.add_keywords(responses(spark, folder), STOP, text="response_text")
    df = df.withColumn("json", P.bag_to_json(F.col("keywords")))
    back = P.bag_from_json(F.col("json"))
    return df.select("response_id", "json", P.bag_keys(back).alias("keys"),
                     F.size(back).alias("n"))


# --- vocabulary -----------------------------------------------------------------


def benchmark_cells(spark, folder):
    note = F.concat(F.lit(" (note "), F.col("item_id"), F.lit("), Career; "))
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("pos"),
        F.concat(F.col("text"), note, F.lit("jobs etc., AI??; ai")).alias("keywords_raw"),
        F.when(F.col("item_id") % 3 > 0, F.concat(F.lit("cat"), F.col("item_id") % 3))
        .otherwise("nan").alias("category"))


@query
def vocab_parse(spark, folder):
    return vocabulary.parse_vocabulary(benchmark_cells(spark, folder))


@query
def vocab_in_text(spark, folder):
    return matching.matches(responses(spark, folder), VOCABULARY, "response_text", "response_id")


@query
def vocab_in_text_joined(spark, folder):
    vocab = vocabulary.parse_vocabulary(benchmark_cells(spark, folder), notes=False)
    return matching.matches_joined(responses(spark, folder), vocab, "response_text",
                                   "response_id").select("response_id", "pos", "keyword")


@query
def vocab_present(spark, folder):
    return matching.present_keywords(responses(spark, folder), VOCABULARY, "response_text",
                                     "response_id")


@query
def vocab_doc_freq(spark, folder):
    freq = matching.document_frequency(responses(spark, folder), VOCABULARY, "response_text",
                                       "response_id")
    return freq.select("keyword", "doc_freq")


# --- vectors --------------------------------------------------------------------


def centroids(spark, folder):
    """A vocabulary of one vector per label: the mean of its members."""
    emb = table(spark, folder, "embeddings")
    means = vectors.mean_by(emb, "label", "embedding", 64, "vec")
    return means.select(F.col("label").alias("pos"),
                        F.concat(F.lit("label"), F.col("label")).alias("keyword"), "vec")


@query
def vector_normalize(spark, folder):
    emb = table(spark, folder, "embeddings").withColumn("u", vectors.normalise(F.col("embedding")))
    return explode_rows(emb, ["vec_id"], F.col("u"), "x", "dim").withColumn("x", F.round("x", 6))


@query
def vector_mean_pool(spark, folder):
    return centroids(spark, folder).select(
        "keyword", F.posexplode("vec").alias("dim", "x")).withColumn("x", F.round("x", 6))


def benchmark_vectors(spark, folder):
    """Benchmark words, numbered in order, take the vectors of those numbers."""
    tokens = F.array_distinct(X.space_tokens(F.lower("text")))
    named = ids.dense_index(explode_rows(table(spark, folder, "benchmark"), [], tokens, "word").distinct(), "word", out="n")
    emb = table(spark, folder, "embeddings").select((F.col("vec_id") + 1).alias("n"), F.col("embedding").alias("vec"))
    return stage(named.join(emb, "n").select("word", "vec"))


@query
def text_mean_vectors(spark, folder):
    means = vectors.mean_vectors(table(spark, folder, "documents"), "text", "doc_id", benchmark_vectors(spark, folder))
    return explode_rows(means, ["doc_id"], F.col("vec"), "x", "dim").withColumn("x", F.round("x", 6))


@query
def best_match(spark, folder):
    emb = table(spark, folder, "embeddings")
    best = vectors.best_match(emb, "vec_id", "embedding", centroids(spark, folder))
    return best.withColumn("similarity", F.round("similarity", 4))


@query
def similar_filter(spark, folder):
    emb = table(spark, folder, "embeddings")
    kept = vectors.similar_to(emb, "vec_id", "embedding", centroids(spark, folder))
    return kept.withColumn("similarity", F.round("similarity", 4))


# --- topics ---------------------------------------------------------------------


def inferred(spark, folder):
    return topics.inferred_topics(responses(spark, folder), "response_text", "response_id", STOP)


def universe(spark, folder):
    return topics.topic_universe(PROVIDED_TOPICS, inferred(spark, folder))


def topic_table(spark, rows):
    return small_table(spark, list(rows), pos=pa.int64(), topic=pa.string())


@query
def tfidf_weights(spark, folder):
    out = topics.tfidf(responses(spark, folder), "response_text", "response_id", STOP)
    return out.withColumn("weight", F.round("weight", 6))


@query
def topic_terms(spark, folder):
    return topic_table(spark, enumerate(inferred(spark, folder), 1))


@query
def topic_universe(spark, folder):
    provided = topic_table(spark, enumerate(PROVIDED_TOPICS))
    return topics.topic_universe_table(provided, topic_terms(spark, folder))


@query
def topic_assignments(spark, folder):
    names = [t for _, t, _ in universe(spark, folder)]
    return topics.assign_topics(responses(spark, folder), names, "response_text", "response_id")


@query
def topics_column(spark, folder):
    names = [t for _, t, _ in universe(spark, folder)]
    df = topics.with_topics(responses(spark, folder), names, "response_text")
    return df.select("response_id", F.array_join("topics", ", ").alias("topics"))


@query
def topic_counts(spark, folder):
    return topics.topic_counts(topic_assignments(spark, folder))


@query
def topic_matrix(spark, folder):
    assigned = topics.assign_topics(responses(spark, folder), PROVIDED_TOPICS, "response_text",
                                    "response_id")
    return topics.topic_matrix(assigned, PROVIDED_TOPICS, "response_id")


# --- aggregates -----------------------------------------------------------------


@query
def question_stats(spark, folder):
    return summary.question_stats(scored(spark, folder), ["question_text_original"])


@query
def survey_sources(spark, folder):
    return summary.survey_sources(responses(spark, folder), ["question_text"])


@query
def question_keywords(spark, folder):
    return summary.keyword_totals(with_bags(spark, folder), ["question_text_original"]).select(
        "question_text_original", "keyword", "frequency")


@query
def summary_by_question(spark, folder):
    return summary.summary_by_question(enriched(spark, folder))


def pool(spark, folder):
    base = stage(keyphrases.add_keywords(responses(spark, folder), STOP, text="response_text"))
    freq = matching.document_frequency(base, VOCABULARY, "response_text", "response_id")
    return summary.keyword_pool(summary.keyword_totals(base, []), freq)


@query
def keyword_pool(spark, folder):
    return pool(spark, folder).select("keyword", "frequency")


@query
def keyword_instances(spark, folder):
    return summary.instances(pool(spark, folder), *summary.POOL_ORDER)


@query
def keyword_instances_legacy(spark, folder):
    kept = summary.meaningful_questions(with_bags(spark, folder), "question_text_original")
    totals = summary.keyword_totals(kept, [])
    return summary.instances(totals, "first_seen", limit=10)


@query
def run_profile(spark, folder):
    df = topics.with_topics(enriched(spark, folder), PROVIDED_TOPICS, "response_text_original")
    return summary.run_profile(df, topics="topics")


@query
def summary_profile(spark, folder):
    return summary.summary_profile(summary_by_question(spark, folder))


@query
def responses_with_features(spark, folder):
    names = [t for _, t, _ in universe(spark, folder)]
    df = topics.with_topics(enriched(spark, folder), names, "response_text_original")
    return df.select(
        "response_id", "survey_id", "question_id", F.col("response_text_original").alias("response_text"),
        "sentiment_label", "sentiment_score", P.bag_keys(F.col("keywords")).alias("keywords"),
        F.array_join("topics", ", ").alias("topics"), P.bag_keys(F.col("keywords")).alias("theme"),
        F.col("question_text_original").alias("question_text"), "sheet_name")


# --- quality --------------------------------------------------------------------


def contract_input(spark, folder):
    """documents with the columns of the input contract; unlabelled ones have nulls."""
    labels = table(spark, folder, "labels")
    times = table(spark, folder, "events").select(F.col("event_id").alias("doc_id"), "ts")
    docs = table(spark, folder, "documents").join(labels, "doc_id", "left").join(times, "doc_id", "left")
    return docs.select(
        F.col("doc_id").alias("survey_id"), F.col("quality").cast("double").alias("question_id"),
        F.when(F.col("toxic").isNotNull(), F.col("lang")).alias("question_text"),
        F.col("doc_id").alias("response_id"),
        F.when(F.col("lang") != "fr", F.when(F.col("quality") == 0, " ").otherwise(F.col("text")))
        .alias("response_text"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Timestamp"),
        F.when(F.col("quality") == 1, F.col("source")).alias("survey_source"),
        F.when(F.col("toxic") == 0, F.col("source")).alias("email"))


@query
def validate_ids(spark, folder):
    events = table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("response_id"), F.col("event_type").alias("survey_id"),
        F.get_json_object("props", "$.k").alias("question_id"))
    return events.agg(*[F.count_if(quality.bad_id(c)).alias(f"bad_{c}") for c in events.columns])


@query
def validate_timestamp(spark, folder):
    events = table(spark, folder, "events").select(
        F.when(F.col("event_type") == "error", F.col("event_type"))
        .when(F.col("event_type") != "view", F.col("ts").cast("string")).alias("Timestamp"))
    return events.agg(F.count("*").alias("total"), F.count("Timestamp").alias("filled"),
                      F.count_if(quality.bad_timestamp("Timestamp")).alias("bad"))


@query
def validate_content(spark, folder):
    return quality.content_counts(contract_input(spark, folder))


@query
def source_distribution(spark, folder):
    return quality.source_distribution(contract_input(spark, folder))


@query
def validate_report(spark, folder):
    return quality.validate(contract_input(spark, folder)).report


@query
def validate_failing(spark, folder):
    """A column is missing, an id is text and half of the times are unreadable."""
    bad = contract_input(spark, folder).drop("question_text").withColumns({
        "question_id": F.concat(F.lit("q"), F.col("survey_id")),
        "Timestamp": F.when(F.col("survey_id") % 2 == 0, F.lit("soon")).otherwise(F.lit("2024-01-02 03:04:05"))})
    return quality.validate(bad).report


# --- consumer queries -------------------------------------------------------------


@query
def response_detail(spark, folder):
    return reports.response_detail(scored(spark, folder), label="negative").select(
        "response_id", "question_text_original", "sentiment_score")


@query
def length_vs_sentiment(spark, folder):
    return reports.length_vs_sentiment(scored(spark, folder))


@query
def questions_by_sentiment(spark, folder):
    stats = summary.question_stats(with_ids(scored(spark, folder)))
    return reports.questions_by_sentiment(stage(stats))


@query
def top_questions(spark, folder):
    stats = summary.question_stats(with_ids(scored(spark, folder)))
    return reports.top_questions(stats, 3)


@query
def keyword_min_frequency(spark, folder):
    totals = summary.keyword_totals(with_bags(spark, folder), ["question_text_original"])
    return reports.keyword_min_frequency(totals, 5)


@query
def filter_by_topic(spark, folder):
    df = topics.with_topics(with_bags(spark, folder), PROVIDED_TOPICS, "response_text_original")
    # filters on computed columns would be pushed down and evaluate them twice
    df = stage(df.select("response_id", "sheet_name", "question_text_original", "keywords", "topics"))
    return reports.filter_responses(df, topic="Thing", keyword="the", question_contains="E").select(
        "response_id", "sheet_name", F.array_join("topics", ", ").alias("topics"))


@query
def responses_over_time(spark, folder):
    return reports.responses_over_time(table(spark, folder, "events"), "ts")


@query
def responses_join_summary(spark, folder):
    df = stage(with_ids(scored(spark, folder)))
    stats = summary.question_stats(df).drop("question_text_original")
    return reports.responses_join_summary(
        df.select("response_id", "question_id", "sentiment_label"), stats)
