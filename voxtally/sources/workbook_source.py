"""Workbooks as a Spark data source split at sheets, and a streaming workbook writer.

``spark.read.format("workbook").load(folder_or_file)`` gives the rows of
``CELL_SCHEMA``: a sheet is one input partition; with the option ``tasks``
neighbouring sheets share one where there are more sheets than that. A sheet
is parsed as a stream of XML rows; a workbook is opened and its shared strings
are read once a partition. A sheet that cannot be read gives the cells read
before the damage and one row with ``error``; the other sheets are not
touched. A file that is no workbook gives one row with ``error``.

Files are opened with Python's own I/O on the driver (sheet lists) and the
executors (sheets), so paths must be visible to both: a local or mounted
shared folder.
"""

from __future__ import annotations

import os
import re
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack
from itertools import groupby
from typing import NamedTuple
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .csv_folder import header_names
from .workbook import _M, CELL_SCHEMA, _cell_text, _column_index, _date_styles, _shared_strings, _sheets

_NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
ROWS_PER_SHEET = 50_000      # a sheet of the writer; the format allows 1,048,576
TASKS_PER_CORE = 4           # from so many sheets a core on, neighbouring sheets share a task
PARTITION_BYTES = 64 << 20   # XML a task reads, where no single sheet holds more
SHEET_COST = 4096            # bytes of XML as dear as opening a sheet
READ_ERRORS = (OSError, zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, IndexError)
_XML_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")      # not allowed in XML 1.0


def local(path: str) -> str:
    """A path Python can open: ``file:`` URIs lose their scheme; other schemes are refused."""
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        raise ValueError(f"workbooks are opened with Python's I/O; {path} is not a local or mounted path")
    return path


class Sheet(NamedTuple):
    """A sheet to read, or with ``error`` a file that has none."""
    path: str
    pos: int | None = None
    name: str | None = None
    part: str | None = None
    size: int = 0                # bytes of its XML
    error: str | None = None


class SheetPartition(InputPartition):
    def __init__(self, sheets: list[Sheet]):
        super().__init__([(s.path, s.pos) for s in sheets])
        self.sheets = sheets


def _pack(sheets: list[Sheet], tasks: int) -> list[list[Sheet]]:
    """Neighbouring sheets in about ``tasks`` groups of like size, none far beyond ``PARTITION_BYTES`` unless by one sheet."""
    if len(sheets) <= tasks:
        return [[s] for s in sheets]
    weights = [s.size + SHEET_COST for s in sheets]
    share = min(sum(weights) / tasks, PARTITION_BYTES)
    groups, filled = [], share
    for sheet, weight in zip(sheets, weights):
        if filled >= share:
            groups.append([])
            filled = 0
        groups[-1].append(sheet)
        filled += weight
    return groups


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, tasks: int | None = None):
        self.path, self.tasks = local(path), tasks

    def partitions(self) -> list[SheetPartition]:
        """The sheets of every ``.xlsx`` file; only each file's directory and sheet list are read."""
        if os.path.isdir(self.path):
            files = sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.lower().endswith(".xlsx"))
        else:
            files = [self.path]
        out = []
        for path in files:
            try:
                with zipfile.ZipFile(path) as book:
                    sizes = {i.filename: i.file_size for i in book.infolist()}
                    out.extend(Sheet(path, pos, name, part, sizes.get(part, 0))
                               for pos, (name, part) in enumerate(_sheets(book)))
            except (OSError, zipfile.BadZipFile, KeyError, ET.ParseError, TypeError) as error:
                out.append(Sheet(path, error=f"{type(error).__name__}: {error}"))
        out = out or [Sheet(self.path, error="no workbook")]
        return [SheetPartition(group) for group in _pack(out, self.tasks or len(out))]

    def read(self, partition: SheetPartition) -> Iterator[pa.RecordBatch]:
        for path, sheets in groupby(partition.sheets, key=lambda s: s.path):
            yield from _read_book(path, list(sheets))


def _read_book(path: str, sheets: list[Sheet]) -> Iterator[pa.RecordBatch]:
    """The cells of some sheets of one workbook, which is opened once."""
    file, names = os.path.basename(path), [c.split()[0] for c in CELL_SCHEMA.split(", ")]

    def failed(sheet: Sheet, error: Exception) -> tuple:
        return file, sheet.name, sheet.pos, None, None, None, None, f"{type(error).__name__}: {error}"

    if sheets[0].error:
        yield _cells([(file, None, None, None, None, None, None, sheets[0].error)], names)
        return
    rows: list[tuple] = []
    with ExitStack() as stack:
        try:
            book = stack.enter_context(zipfile.ZipFile(path))
            strings, dates = _shared_strings(book), _date_styles(book)     # once a partition
        except READ_ERRORS as error:
            yield _cells([failed(sheet, error) for sheet in sheets], names)
            return
        for sheet in sheets:
            try:
                for row in _sheet_rows(book, sheet, file, strings, dates):
                    rows += row
                    if len(rows) >= 10_000:
                        yield _cells(rows, names)
                        rows = []
            except READ_ERRORS as error:
                rows.append(failed(sheet, error))
    if rows:
        yield _cells(rows, names)


def _sheet_rows(book: zipfile.ZipFile, sheet: Sheet, file: str, strings, dates) -> Iterator[list[tuple]]:
    headers: dict[int, str] = {}
    last = 0
    with book.open(sheet.part) as stream:
        for _, row in ET.iterparse(stream):
            if row.tag != f"{_M}row":
                continue
            last = int(row.get("r", last + 1))
            cells, at = {}, -1
            for cell in row.findall(f"{_M}c"):
                at = _column_index(cell.get("r")) if cell.get("r") else at + 1
                text = _cell_text(cell, strings, dates)
                if text is not None:
                    cells[at] = text
            if last == 1:
                width = max(cells, default=-1) + 1
                headers = dict(enumerate(header_names([cells.get(i) for i in range(width)])))
            yield [(file, sheet.name, sheet.pos, last - 1, col, None if last == 1 else headers.get(col, f"Unnamed: {col}"),
                    text, None) for col, text in cells.items()]
            row.clear()


def _cells(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)


class WorkbookSource(DataSource):
    """``format("workbook")``: cells of every sheet, one input partition per sheet."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return CELL_SCHEMA

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"], int(self.options.get("tasks", 0)) or None)


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """Cells of the workbooks at ``path`` (a file or a folder), split at sheets; small ones share a task."""
    spark.dataSource.register(WorkbookSource)
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    return spark.read.format("workbook").option("tasks", tasks).load(path)


def _sheet_xml(rows: list[list[str | None]], first: int) -> str:
    def ref(r: int, c: int) -> str:
        name, c = "", c + 1
        while c:
            c, rest = divmod(c - 1, 26)
            name = chr(65 + rest) + name
        return f"{name}{r}"
    body = []
    for r, row in enumerate(rows, first):
        cells = "".join(f'<c r="{ref(r, c)}" t="inlineStr"><is><t xml:space="preserve">{escape(_XML_BAD.sub("\ufffd", v))}</t></is></c>'
                        for c, v in enumerate(row) if v is not None)
        body.append(f'<row r="{r}">{cells}</row>')
    return "".join(body)


def _end_sheet(stream) -> None:
    if stream is not None:
        stream.write(b"</sheetData></worksheet>")
        stream.close()


def write_workbooks(df: DataFrame, folder: str, rows_per_sheet: int = ROWS_PER_SHEET) -> DataFrame:
    """Each task writes its rows as one workbook in ``folder``, a new sheet every ``rows_per_sheet`` rows.

    Every sheet starts with the column names; values are written as text
    (inline strings, NULL as no cell; characters XML 1.0 does not allow
    become U+FFFD). Rows are streamed into the file, so a
    task holds one batch at a time. Returns the written paths, one row a task.
    """
    columns = df.columns
    target = local(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, path, sheets, filled, stream = None, None, 0, rows_per_sheet, None
        for batch in batches:
            values = [[None if v is None else str(v) for v in col.to_pylist()] for col in batch.columns]
            for row in zip(*values):
                if book is None:                    # a task without rows writes no file
                    os.makedirs(target, exist_ok=True)
                    path = os.path.join(target, f"book-{uuid.uuid4().hex}.xlsx")
                    book = zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED)
                if filled >= rows_per_sheet:
                    _end_sheet(stream)
                    sheets, filled = sheets + 1, 0
                    stream = book.open(f"xl/worksheets/sheet{sheets}.xml", "w")
                    stream.write(f'<worksheet xmlns="{_NS}"><sheetData>{_sheet_xml([columns], 1)}'.encode())
                stream.write(_sheet_xml([list(row)], filled + 2).encode())
                filled += 1
        if book is None:
            return
        _end_sheet(stream)
        names = "".join(f'<sheet name="rows{i}" sheetId="{i}" r:id="rId{i}"/>' for i in range(1, sheets + 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS}" xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, sheets + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{links}</Relationships>")
        book.close()
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([sheets], pa.int32())], ["path", "sheets"])

    return df.mapInArrow(write, "path string, sheets int")
