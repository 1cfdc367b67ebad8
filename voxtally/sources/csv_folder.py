"""CSV surveys: one wide table per file, one question per column."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.wordlists import NULL_TOKENS
from ..operators.reshape import is_provenance, unpivot_long, with_sheet
from ..session import SPARK_ERRORS
from .csv_split import read_csv_split
from .files import file_stem, list_files

log = logging.getLogger(__name__)

HEADERS_AT_ONCE = 16
POSITION = ("source_file", "sheet_pos", "col_pos", "block", "row_pos")
CELL_COLUMNS = ("question_text", "response_text", "sheet_name", *POSITION)


def _reader(spark: SparkSession, multiline: bool):
    return (spark.read.option("quote", '"').option("escape", '"')
            .option("mode", "PERMISSIVE").option("multiLine", multiline))


def header_names(cells: Sequence[str | None], ignore_case: bool = False) -> list[str]:
    """Column names of a header row: blanks are numbered, repeats get a suffix.

    Spark resolves columns without case, so wide tables use ``ignore_case``.
    """
    names: list[str] = []
    taken: set[str] = set()
    for i, cell in enumerate(cells):
        base = cell if cell not in (None, "") else f"Unnamed: {i}"
        name, n = base, 0
        while (name.lower() if ignore_case else name) in taken:
            n += 1
            name = f"{base}.{n}"
        taken.add(name.lower() if ignore_case else name)
        names.append(name)
    return names


def read_header(spark: SparkSession, path: str, multiline: bool = True) -> list[str]:
    row = _reader(spark, multiline).option("header", False).csv(path).first()
    if not row:
        raise ValueError(f"no columns in {path}")
    return header_names(list(row))


def files_by_header(spark: SparkSession, paths: Sequence[str], multiline: bool = True,
                    failed: list[tuple[str, str]] | None = None) -> dict[tuple[str, ...], list[str]]:
    """Group files with equal headers, so that each group is one scan. A file
    without a readable header is skipped, and added with its error to ``failed``."""
    def header(path: str) -> tuple[str, ...] | Exception:
        try:
            return tuple(read_header(spark, path, multiline))
        except (*SPARK_ERRORS, ValueError) as error:
            return error

    groups: dict[tuple[str, ...], list[str]] = {}
    # a header is one small job on a file's beginning; many run at a time
    with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
        for path, found in zip(paths, pool.map(header, paths)):
            if isinstance(found, Exception):
                log.warning("skipped %s: %s", path, found)
                if failed is not None:
                    failed.append((path, str(found)))
            else:
                groups.setdefault(found, []).append(path)
    return groups


def _scan(spark: SparkSession, width: int, paths: list[str], multiline: bool, block_bytes: int | None = None) -> DataFrame:
    """Cells as ``c0..`` with their file, block and row.

    With ``block_bytes`` files are read in blocks of that size, line breaks in
    quotes included (``csv_split``); else a multi-line file is one task.
    """
    if block_bytes:
        wide = read_csv_split(spark, paths, [f"c{i}" for i in range(width)], block_bytes=block_bytes)
        name = F.element_at(F.split("source_file", "/"), -1)
        return wide.select(*[f"c{i}" for i in range(width)],
                           F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("__file"),
                           F.col("record_block").alias("__block"), F.col("record_ord").alias("__row"))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    wide = _reader(spark, multiline).option("header", True).schema(schema).csv(paths)
    return wide.select(
        *wide.columns,
        F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))).alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__row"))


def scan_csv_long(spark: SparkSession, folder: str, exclude: Sequence[str] = (),
                  multiline: bool = True, null_tokens: Sequence[str] = NULL_TOKENS,
                  failed: list[tuple[str, str]] | None = None, block_bytes: int | None = None) -> DataFrame | None:
    """All non-blank cells of the CSV files in a folder, with their position.

    Answers are read as text. ``multiline`` allows line breaks inside quotes,
    which makes a file one task, unless ``block_bytes`` is given: then files
    are cut into blocks of that size and records found by quote parity
    (``csv_split``), line breaks in quotes included. ``exclude``
    holds the full paths of files that are not surveys, as Spark lists them.
    Skipped files are added to ``failed``. None when the folder holds no usable
    file.
    """
    paths = [p for p in list_files(spark, folder, "csv") if p not in exclude]
    tables = []
    for header, group in files_by_header(spark, paths, multiline, failed).items():
        questions = {f"c{i}": name for i, name in enumerate(header) if not is_provenance(name)}
        if not questions:
            continue
        long = unpivot_long(_scan(spark, len(header), group, multiline, block_bytes), ("__file", "__block", "__row"),
                            questions, null_tokens)
        tables.append(long.select(
            "question_text", "response_text", file_stem(F.col("__file")).alias("sheet_name"),
            F.col("__file").alias("source_file"), F.lit(0).alias("sheet_pos"), "col_pos",
            F.col("__block").alias("block"), F.col("__row").alias("row_pos")))
    return reduce(DataFrame.unionByName, tables) if tables else None


def load_wide(spark: SparkSession, folder: str, multiline: bool = True,
              null_tokens: Sequence[str] = NULL_TOKENS) -> list[DataFrame]:
    """One wide table per CSV file, nulls as empty text, ``sheet_name`` last."""
    tables = []
    for header, group in files_by_header(spark, list_files(spark, folder, "csv"), multiline).items():
        for path in group:
            names = header_names(header, ignore_case=True)
            wide = _scan(spark, len(names), [path], multiline).select(*[
                F.when(~F.col(f"c{i}").isin(list(null_tokens)), F.col(f"c{i}")).alias(name)
                for i, name in enumerate(names)])
            stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            tables.append(with_sheet(wide, stem, first=False, fill=""))
    return tables


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table written by an earlier step; an error if it is missing."""
    return _reader(spark, True).option("header", True).csv(path)
