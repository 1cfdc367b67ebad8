"""Wide survey tables to one row per answer."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from ..functions.wordlists import NON_TEXT_COLUMNS, PROVENANCE_HEADERS, SHEETS_TO_EXCLUDE
from .ids import first_seen_ids, response_ids

LONG_COLUMNS = ("response_id", "survey_id", "question_id", "question_text", "response_text",
                "sheet_name", "source_file", "timestamp")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def is_provenance(header: str) -> bool:
    """Whether a header names the sheet the row came from."""
    return re.sub(r"\s+", " ", header).strip().lower() in PROVENANCE_HEADERS


def question_columns(df: DataFrame, keep: Sequence[str] = ()) -> list[str]:
    return [c for c in df.columns if c not in keep and not is_provenance(c)]


def unpivot_long(df: DataFrame, keep: Sequence[str], questions: dict[str, str] | None = None,
                 null_tokens: Sequence[str] = ()) -> DataFrame:
    """One row per non-blank cell: ``keep``, col_pos, question_text, response_text.

    ``questions`` maps columns to question texts; by default every column but
    ``keep`` and provenance is a question under its own name. Wholly null columns
    leave no rows, so they need no separate pass.
    """
    if questions is None:
        questions = {c: c for c in question_columns(df, keep)}
    cells = df.select(*[quoted(k) for k in keep], F.explode(F.array(*[
        F.struct(F.lit(i).alias("col_pos"), F.lit(label).alias("question_text"),
                 quoted(c).cast("string").alias("response_text"))
        for i, (c, label) in enumerate(questions.items())])).alias("_cell"))
    text = F.col("_cell.response_text")
    present = text.isNotNull() & ~is_blank(text)
    if null_tokens:
        present = present & ~text.isin(list(null_tokens))
    return cells.filter(present).select(
        *[quoted(k) for k in keep], "_cell.col_pos", "_cell.question_text",
        strip(text).alias("response_text"))


def assign_ids(long: DataFrame, *order: Column | str) -> DataFrame:
    """Response, question and survey ids and one timestamp for the run."""
    numbered = response_ids(long, *order)
    numbered = first_seen_ids(numbered, "question_text", "response_id", "question_id")
    numbered = first_seen_ids(numbered, "sheet_name", "response_id", "survey_id")
    return numbered.withColumn("timestamp", F.current_timestamp()).select(*LONG_COLUMNS)


def exclude_sheets(df: DataFrame, sheet: str = "sheet_name",
                   patterns: Sequence[str] = SHEETS_TO_EXCLUDE) -> DataFrame:
    """Drop rows whose sheet name contains a pattern, ignoring case."""
    name = F.lower(F.col(sheet))
    return df.filter(reduce(lambda a, p: a & ~F.contains(name, F.lit(p)), patterns, F.lit(True)))


def exclude_sheets_exact(df: DataFrame, sheet: str = "sheet_name",
                         names: Sequence[str] = SHEETS_TO_EXCLUDE) -> DataFrame:
    """Drop rows whose sheet name equals one of the names."""
    return df.filter(~F.col(sheet).isin(list(names)))


def with_sheet(df: DataFrame, sheet: str, first: bool = True, fill: str | None = None) -> DataFrame:
    """Add a constant ``sheet_name`` as first or last column; optionally fill nulls.

    Filling with a text turns every column into text, as the answers are.
    """
    others = [c for c in df.columns if c != "sheet_name"]
    cols = [quoted(c) if fill is None else
            F.coalesce(quoted(c).cast("string"), F.lit(fill)).alias(c) for c in others]
    name = F.lit(sheet).alias("sheet_name")
    return df.select(*([name] + cols if first else cols + [name]))


def wide_union(tables: Sequence[DataFrame]) -> DataFrame:
    """All wide tables as one relation, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def text_column_flags(df: DataFrame, exclude: Sequence[str] = NON_TEXT_COLUMNS, ignore_case: bool = True,
                      nulls_are_text: bool = False) -> DataFrame:
    """One row: per column, whether any value holds a letter A-Z. One pass for all.

    Without ``ignore_case`` only columns named exactly as an excluded one are
    left out. ``nulls_are_text`` reads a NULL cell as the word "nan", as tools
    do that turn cells into text first; by default a NULL has no letter.
    """
    fold = str.lower if ignore_case else str
    skip = {fold(e) for e in exclude}
    names = [c for c in df.columns if fold(c) not in skip]
    return df.agg(*[F.coalesce(F.bool_or(F.coalesce(quoted(c).cast("string").rlike("[A-Za-z]"), F.lit(nulls_are_text))),
                               F.lit(False)).alias(c) for c in names])


def text_columns(df: DataFrame, exclude: Sequence[str] = NON_TEXT_COLUMNS, ignore_case: bool = True,
                 nulls_are_text: bool = False) -> list[str]:
    """Names of the text columns, in order (one aggregate job, one row back)."""
    flags = text_column_flags(df, exclude, ignore_case, nulls_are_text)
    row = flags.first()
    return [c for c, flag in zip(flags.columns, row) if flag]


def combine_row_text(columns: Sequence[str]) -> Column:
    """Trimmed non-blank, non-"nan" values of a row joined by a space."""
    def part(name: str) -> Column:
        value = strip(quoted(name).cast("string"))
        return F.when((value != "") & (F.lower(value) != "nan"), value)

    return F.concat_ws(" ", *[part(c) for c in columns])
