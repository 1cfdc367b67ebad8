"""The full run: folder of surveys in, four tables out."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phrases as P
from ..functions import wordlists as L
from ..functions.text import strip
from ..operators import cleaning, keyphrases, matching, reshape, sentiment, summary, topics, vectors
from ..session import small_table, stage
from ..sources import csv_folder, vocabulary, workbook
from ..sources.sink import write_csv

log = logging.getLogger(__name__)

FEATURE_COLUMNS = ("response_id", "survey_id", "question_id", "response_text", "sentiment_label",
                   "sentiment_score", "keywords", "topics", "theme", "question_text", "sheet_name",
                   "source_file")


@dataclass(frozen=True)
class Settings:
    """Parameters of a run."""
    vocabulary_file: str | None = None
    topics_file: str | None = None
    num_topics: int = 5
    max_phrases: int = 5
    similarity_threshold: float = L.SIMILARITY_THRESHOLD
    stop_words: Sequence[str] | None = None          # default: Spark's English list
    excluded: Sequence[str] = L.GENERIC_WORDS
    lemmas: DataFrame | dict[str, str] | None = None  # (word, lemma)
    lexicon: DataFrame | None = None                 # (term, valence); None: word sets
    word_vectors: DataFrame | None = None            # (word, vec); None: no similarity filter
    encoder: Callable | None = None                  # see vectors.embed; wins over word_vectors
    topic_stop_words: Sequence[str] | None = None    # of topic terms; default: as stop_words
    skip_vocabulary: bool = True                     # a vocabulary file in the folder is no survey
    single_file: bool = False


@dataclass(frozen=True)
class RunResult:
    responses: DataFrame
    summary: DataFrame
    keywords: DataFrame
    topics: DataFrame | None
    topic_names: list[str] | None        # None: too many, ``topics`` then has one row each
    profile: DataFrame
    failed: list[tuple[str, str]] = field(default_factory=list)   # files not read (whole), and why
    paths: dict[str, str] = field(default_factory=dict)


def ingest(spark: SparkSession, folder: str, skip: Sequence[str] = (),
           failed: list[tuple[str, str]] | None = None) -> DataFrame:
    """The long response table of all CSV files and workbook sheets of a folder.

    ``skip`` holds full paths. Files that could not be read, or not to the end,
    are logged and added with their error to ``failed``.
    """
    parts, failed = [], [] if failed is None else failed
    csv = csv_folder.scan_csv_long(spark, folder, exclude=skip, failed=failed)
    if csv is not None:
        parts.append(csv)
    cells = workbook.scan_workbooks(spark, folder)
    if cells is not None:
        cells = stage(cells)
        # at most one row per file
        for r in cells.filter("error is not null").select("source_file", "error").collect():
            log.warning("damaged %s: %s", r["source_file"], r["error"])
            failed.append((r["source_file"], r["error"]))
        answers = reshape.exclude_sheets(cells.filter("error is null and row_pos > 0"))
        answers = answers.withColumns({"question_text": F.col("header"), "block": F.lit(0).cast("long"),
                                       "response_text": F.col("value")})
        normal = F.lower(F.trim(F.regexp_replace("header", r"\s+", " ")))
        text = F.col("response_text")
        answers = answers.filter(~normal.isin(list(L.PROVENANCE_HEADERS))
                                 & ~text.isin(list(L.NULL_TOKENS)))
        answers = answers.withColumn("response_text", strip(text)).filter("response_text <> ''")
        parts.append(answers.select(*csv_folder.CELL_COLUMNS))
    if not parts:
        raise ValueError(f"no data in {folder}")
    long = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    long = reshape.assign_ids(long, *csv_folder.POSITION)
    if long.isEmpty():
        raise ValueError(f"no data in {folder}")
    return long


def similarity_filter(settings: Settings, vocab: DataFrame | None) -> Callable | None:
    """Filter of distinct phrases by closeness to the vocabulary, if vectors are given."""
    if vocab is None or (settings.encoder is None and settings.word_vectors is None):
        return None

    def vectorise(df: DataFrame) -> DataFrame:
        if settings.encoder is not None:
            return vectors.embed(df, "keyword", "vec", settings.encoder)
        return vectors.mean_vectors(df, "keyword", "keyword", settings.word_vectors,
                                    missing_as_zero=True)

    reference = stage(vocab.select("pos", "keyword").join(
        vectorise(vocab.select("keyword")), "keyword"))

    def keep(phrases: DataFrame) -> DataFrame:
        return vectors.similar_to(vectorise(phrases), "keyword", "vec", reference,
                                  settings.similarity_threshold)

    return keep


def enrich(long: DataFrame, settings: Settings, vocab: DataFrame | None,
           stop: Sequence[str]) -> DataFrame:
    """Cleaned texts, sentiment and keyword bags for each response."""
    df = cleaning.preprocess(long, stop, settings.lemmas)
    if settings.lexicon is None:
        df = sentiment.add_wordset_sentiment(df)
    else:
        df = sentiment.add_lexicon_sentiment(df, settings.lexicon)
    return keyphrases.add_keywords(df, stop, vocab, excluded=settings.excluded,
                                   k=settings.max_phrases,
                                   similar=similarity_filter(settings, vocab))


def features(df: DataFrame) -> DataFrame:
    """The published response columns; ``keywords`` and ``theme`` hold the same list."""
    return df.withColumns({
        "keywords": P.bag_keys(F.col("keywords")),
        "theme": P.bag_keys(F.col("keywords")),
        "topics": F.array_join("topics", ", "),
        "response_text": F.col("response_text_original"),
        "question_text": F.col("question_text_original"),
    }).select(*FEATURE_COLUMNS)


def run(spark: SparkSession, data_folder: str, output_folder: str | None = None,
        settings: Settings = Settings()) -> RunResult:
    """Ingest, clean, score, extract, infer topics, summarise and (optionally) write.

    The enriched responses are written once to the shared folder, since every
    later step reads them.
    """
    stop = list(settings.stop_words if settings.stop_words is not None else L.ENGLISH_STOP_WORDS)
    vocab, vocab_path = vocabulary.find_vocabulary(spark, data_folder, settings.vocabulary_file)
    skip = [vocab_path] if vocab_path and settings.skip_vocabulary else []
    failed: list[tuple[str, str]] = []
    responses = stage(enrich(ingest(spark, data_folder, skip, failed), settings, vocab, stop))

    text, key = "response_text_original", "response_id"
    given = vocabulary.provided_topics(spark, settings.topics_file)
    provided = vocabulary.topic_names(given)
    term_stop = stop if settings.topic_stop_words is None else list(settings.topic_stop_words)
    inferred = topics.inferred_topics(responses, text, key, term_stop, settings.num_topics, settings.excluded)
    if provided is None:
        # too many to inline: the topics stay a table, and so does their result
        more = small_table(spark, list(enumerate(inferred)), pos=pa.int64(), topic=pa.string())
        universe = stage(topics.topic_universe_table(given.select("pos", F.col("keyword").alias("topic")), more))
        names, listed = None, universe.select("pos", F.col("topic").alias("keyword"))
    else:
        names = listed = [t for _, t, _ in topics.topic_universe(provided, inferred)]
    tagged = topics.with_topics(responses, listed, text)

    totals = summary.keyword_totals(responses, [])
    pool, ties = totals, ("first_seen",)
    if vocab is not None:
        pool = summary.keyword_pool(totals, matching.document_frequency(responses, vocab, text, key))
        ties = summary.POOL_ORDER
    matrix, assigned = None, tagged.select(key, F.explode("topics").alias("topic"))
    if names is None:
        matrix = topics.topic_rows(assigned, key)
    elif names:
        matrix = topics.topic_matrix(assigned, names, key)
    result = RunResult(features(tagged), summary.summary_by_question(responses),
                       summary.instances(pool, *ties), matrix, names,
                       summary.run_profile(tagged, topics="topics"), failed)
    if output_folder is None:
        return result
    one = settings.single_file
    paths = {
        "responses": write_csv(result.responses, output_folder, "responses_with_features.csv", one),
        "summary": write_csv(result.summary, output_folder, "summary_by_question.csv", one),
        "keywords": write_csv(result.keywords, output_folder, "keywords.csv", one),
    }
    if matrix is not None:
        table = matrix if names is None else matrix.orderBy("row_no").drop("row_no")
        paths["topics"] = write_csv(table, output_folder, "topics.csv", one)
    return RunResult(result.responses, result.summary, result.keywords, matrix, names,
                     result.profile, failed, paths)
