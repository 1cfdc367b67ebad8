"""Workbook (.xlsx) cells as a table.

A workbook is a zip of XML parts and cannot be split, so each is one task; its
size is bounded by the format. Spark lists and distributes the files.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wordlists import SHEETS_TO_EXCLUDE
from ..operators.reshape import exclude_sheets_exact, with_sheet
from ..session import stage
from .csv_folder import header_names
from .files import list_files

CELL_SCHEMA = ("source_file string, sheet_name string, sheet_pos int, row_pos long, col_pos int, "
               "header string, value string, error string")
_BATCH = 20_000
_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Built-in number formats that show a date or time.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _part(book: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(book.read(name)) if name in book.namelist() else None


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    root = _part(book, "xl/sharedStrings.xml")
    if root is None:
        return []
    return ["".join(t.text or "" for t in si.findall(f"{_M}t") + si.findall(f"{_M}r/{_M}t"))
            for si in root.findall(f"{_M}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    root = _part(book, "xl/styles.xml")
    if root is None:
        return set()
    dates = set(_DATE_FORMATS)
    for fmt in root.findall(f"{_M}numFmts/{_M}numFmt"):
        code = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", fmt.get("formatCode", ""))
        if re.search(r"[ymdhs]", code, re.I):
            dates.add(int(fmt.get("numFmtId")))
    return {i for i, xf in enumerate(root.findall(f"{_M}cellXfs/{_M}xf"))
            if int(xf.get("numFmtId", 0)) in dates}


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    links = {r.get("Id"): r.get("Target") for r in _part(book, "xl/_rels/workbook.xml.rels")}
    out = []
    for sheet in _part(book, "xl/workbook.xml").findall(f"{_M}sheets/{_M}sheet"):
        target = links[sheet.get(f"{_R}id")]
        out.append((sheet.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _column_index(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _cell_text(cell: ET.Element, strings: list[str], dates: set[int]) -> str | None:
    kind, raw = cell.get("t", "n"), cell.findtext(f"{_M}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_M}t"))
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return strings[int(raw)]
    if kind == "b":
        return str(raw == "1")
    if kind != "n":
        return raw
    number = float(raw)
    if int(cell.get("s", 0)) in dates:
        moment = dt.datetime(1899, 12, 30) + dt.timedelta(days=number)
        return str((moment + dt.timedelta(microseconds=500_000)).replace(microsecond=0))
    return str(int(number)) if number.is_integer() else repr(number)


def workbook_cells(content: bytes) -> Iterator[tuple]:
    """``(sheet, sheet_pos, row_pos, col_pos, header, value)`` per cell with a value;
    the header row has row_pos 0 and no header."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings, dates = _shared_strings(book), _date_styles(book)
        for sheet_pos, (name, part) in enumerate(_sheets(book)):
            headers: dict[int, str] = {}
            row_pos, last_row = -1, 0
            with book.open(part) as stream:
                for _, row in ET.iterparse(stream):
                    if row.tag != f"{_M}row":
                        continue
                    last_row = int(row.get("r", last_row + 1))
                    row_pos = last_row - 1
                    cells: dict[int, str] = {}
                    at = -1
                    for cell in row.findall(f"{_M}c"):
                        at = _column_index(cell.get("r")) if cell.get("r") else at + 1
                        text = _cell_text(cell, strings, dates)
                        if text is not None:
                            cells[at] = text
                    if row_pos == 0:
                        width = max(cells, default=-1) + 1
                        headers = dict(enumerate(header_names([cells.get(i) for i in range(width)])))
                    for col, text in cells.items():
                        header = None if row_pos == 0 else headers.get(col, f"Unnamed: {col}")
                        yield name, sheet_pos, row_pos, col, header, text
                    row.clear()


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [part.split()[0] for part in CELL_SCHEMA.split(", ")]
    for files in batches:
        for path, content in zip(files["path"], files["content"]):
            name, rows = path.rsplit("/", 1)[-1], []
            try:
                for cell in workbook_cells(content):
                    rows.append((name, *cell, None))
                    if len(rows) >= _BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            except Exception as error:   # a damaged file is reported in its own row
                rows.append((name, None, None, None, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=columns)


def read_cells(spark: SparkSession, *paths: str) -> DataFrame:
    """Cells of the given workbooks; a damaged one gives one row with ``error``."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.repartition(len(paths), "path").mapInPandas(_decode, CELL_SCHEMA)


def scan_workbooks(spark: SparkSession, folder: str) -> DataFrame | None:
    """Cells of every workbook in a folder; None when there is none."""
    paths = list_files(spark, folder, "xlsx")
    return read_cells(spark, *paths) if paths else None


def column_values(cells: DataFrame, sheet: str, col_pos: int = 0) -> DataFrame:
    """``(pos, value)`` of one column of a sheet, the first row included; an error
    if the sheet has no such column."""
    of_sheet = cells.filter((F.col("sheet_name") == sheet) & F.col("error").isNull())
    values = of_sheet.filter(F.col("col_pos") == col_pos)
    if values.isEmpty():
        raise ValueError(f"no column {col_pos} in sheet {sheet!r}")
    return values.select(F.col("row_pos").alias("pos"), "value")


def load_wide(spark: SparkSession, folder: str,
              exclude: Sequence[str] = SHEETS_TO_EXCLUDE) -> list[DataFrame]:
    """One wide table per workbook sheet with ``sheet_name`` first; sheets named
    exactly as an excluded one are left out. Cells are decoded once and laid out
    by sheet, so that a table reads its own only."""
    cells = scan_workbooks(spark, folder)
    if cells is None:
        return []
    kept = stage(exclude_sheets_exact(cells.filter("error is null"), names=exclude), "source_file", "sheet_pos")
    where = ("source_file", "sheet_pos", "sheet_name")
    # headers only: as many rows as there are columns
    columns = kept.filter("row_pos > 0").select(*where, "col_pos", "header").distinct().orderBy(
        *where, "col_pos").collect()
    headers: dict[tuple, dict[int, str]] = {}
    for r in columns:
        headers.setdefault((r["source_file"], r["sheet_pos"], r["sheet_name"]),
                           {})[r["col_pos"]] = r["header"]
    tables = []
    for (file, pos, sheet), found in headers.items():
        names = header_names(list(found.values()), ignore_case=True)
        of_sheet = kept.filter((F.col("source_file") == file) & (F.col("sheet_pos") == pos)
                               & (F.col("row_pos") > 0))
        wide = of_sheet.groupBy("row_pos").pivot("col_pos", list(found)).agg(F.first("value"))
        tables.append(with_sheet(wide.drop("row_pos").toDF(*names), sheet))
    return tables
