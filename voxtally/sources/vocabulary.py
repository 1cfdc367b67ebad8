"""Reference vocabularies and topic lists."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE, strip
from ..operators.ids import dense_index
from ..session import SPARK_ERRORS, bounded_rows
from .files import list_files
from .workbook import column_values, read_cells

log = logging.getLogger(__name__)

VOCABULARY_SCHEMA = "pos long, keyword string, norm string, category string"


def clean_keyword(c: Column) -> Column:
    """Without notes in parentheses, a trailing "etc." and trailing "??"."""
    c = strip(F.regexp_replace(strip(c), r"\([^\n]*?\)", ""))
    c = strip(F.regexp_replace(c, rf"(^|[^\p{{L}}\p{{N}}_])etc\.?[{SPACE}]*$", "$1"))
    return strip(F.regexp_replace(c, rf"\?\?+[{SPACE}]*$", ""))


def _usable(c: Column) -> Column:
    return F.when((strip(c) != "") & (F.lower(strip(c)) != "nan"), strip(c))


def parse_vocabulary(cells: DataFrame, notes: bool = True) -> DataFrame:
    """``(pos, keyword, norm, category)`` from cells ``(pos, keywords_raw[, category])``.

    Cells are split at commas and semicolons; of keywords equal without case the
    first spelling stays, with the category of that first sighting. ``notes``
    also strips remarks from each keyword, as the two-column form does.
    """
    category = _usable(F.col("category")) if "category" in cells.columns else F.lit(None).cast("string")
    parts = cells.select("pos", _usable(F.col("keywords_raw")).alias("_raw"), category.alias("_cat"))
    parts = parts.filter("_raw is not null").select(
        "pos", "_cat", F.posexplode(F.split("_raw", rf"[,;][{SPACE}]*")).alias("_part", "_kw"))
    keyword = clean_keyword(F.col("_kw")) if notes else strip(F.col("_kw"))
    named = parts.select("pos", "_part", "_cat", keyword.alias("_kw")).filter("_kw <> ''")
    first = named.groupBy(F.lower("_kw").alias("norm")).agg(
        F.min(F.struct("pos", "_part", "_kw", "_cat")).alias("f"))
    ordered = first.select("norm", F.struct("f.pos", "f._part").alias("_at"),
                           F.col("f._kw").alias("keyword"), F.col("f._cat").alias("category"))
    return dense_index(ordered, "_at", out="pos").select("pos", "keyword", "norm", "category")


def vocabulary_from_csv(spark: SparkSession, path: str) -> DataFrame:
    """Two columns without header: delimited keywords, category."""
    cells = (spark.read.schema("keywords_raw string, category string")
             .option("quote", '"').option("escape", '"').option("multiLine", True).csv(path))
    return parse_vocabulary(cells.withColumn("pos", F.monotonically_increasing_id()))


def vocabulary_from_workbook(spark: SparkSession, path: str, sheet: str = "keywords",
                             col_pos: int = 0) -> DataFrame:
    """Delimited keywords in one column of a sheet."""
    values = column_values(read_cells(spark, path), sheet, col_pos)
    return parse_vocabulary(values.withColumnRenamed("value", "keywords_raw"), notes=False)


def empty_vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], VOCABULARY_SCHEMA)


def provided_topics(spark: SparkSession, path: str | None, sheet: str = "keywords") -> DataFrame:
    """Topics of a workbook sheet; a missing or unusable file gives none, with a warning."""
    if path is None:
        return empty_vocabulary(spark)
    try:
        return vocabulary_from_workbook(spark, path, sheet)
    except (*SPARK_ERRORS, ValueError) as error:
        log.warning("no provided topics from %s: %s", path, error)
        return empty_vocabulary(spark)


def topic_names(topics: DataFrame) -> list[str] | None:
    """Provided topics in order, None when there are too many to inline."""
    rows = bounded_rows(topics.select("pos", "keyword"))
    return None if rows is None else [r["keyword"] for r in sorted(rows, key=lambda r: r["pos"])]


def find_vocabulary(spark: SparkSession, folder: str,
                    path: str | None = None) -> tuple[DataFrame | None, str | None]:
    """The vocabulary and the full path of the file it came from.

    Looked for in order: the explicit path, ``keywords.csv`` in the folder, the
    first workbook with a ``keywords`` sheet.
    """
    def read(p: str) -> DataFrame:
        return vocabulary_from_csv(spark, p) if p.lower().endswith(".csv") \
            else vocabulary_from_workbook(spark, p)

    found = None if path is None else _resolve(spark, path)
    if found is not None:
        return read(found), found
    for candidate in list_files(spark, folder, "csv"):
        if candidate.rsplit("/", 1)[-1] == "keywords.csv":
            return read(candidate), candidate
    for candidate in list_files(spark, folder, "xlsx"):
        try:
            return read(candidate), candidate
        except (*SPARK_ERRORS, ValueError):
            continue
    return None, None


def _resolve(spark: SparkSession, path: str) -> str | None:
    """The path as Spark lists it, None when it cannot be read."""
    try:
        row = spark.read.format("binaryFile").load(path).select("path").first()
    except SPARK_ERRORS:
        return None
    return None if row is None else row["path"]
