"""The two-step form: a cleaned wide table, then a key-phrase column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.phrases import top_phrases_simple
from ..operators.cleaning import preprocess_columns
from ..operators.reshape import combine_row_text, text_columns, wide_union
from ..sources import csv_folder, workbook
from ..sources.sink import write_csv


def clean_folder(spark: SparkSession, folder: str, stop: Sequence[str],
                 lemmas: dict[str, str] | None = None) -> DataFrame:
    """All wide tables of a folder (sheets and CSV files) as one, with cleaned
    text columns."""
    tables = workbook.load_wide(spark, folder) + csv_folder.load_wide(spark, folder)
    if not tables:
        raise ValueError(f"no data in {folder}")
    return preprocess_columns(wide_union(tables), stop, lemmas)


def add_simple_keywords(df: DataFrame, stop: Sequence[str], k: int = 5,
                        columns: Sequence[str] | None = None) -> DataFrame:
    """Add ``keywords``: the top phrases of a row's texts as a comma list."""
    names = list(columns) if columns is not None else text_columns(df)
    if not names:
        raise ValueError("no text columns")
    return df.withColumn("keywords", F.array_join(
        top_phrases_simple(combine_row_text(names), stop, k), ", "))


def run_two_step(spark: SparkSession, folder: str, out: str, stop: Sequence[str]) -> dict[str, str]:
    """Write ``cleaned.csv`` and ``with_keywords.csv`` under ``out``."""
    cleaned = write_csv(clean_folder(spark, folder, stop), out, "cleaned.csv")
    tagged = add_simple_keywords(csv_folder.read_table(spark, cleaned), stop)
    return {"cleaned": cleaned, "with_keywords": write_csv(tagged, out, "with_keywords.csv")}
