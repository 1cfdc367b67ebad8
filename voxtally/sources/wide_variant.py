"""Any number of CSV files with differing headers as one wide table, through VARIANT rows.

All files are one scan (``csv_split``): records are paired with their file's
header by a join, each row becomes one VARIANT object keyed by its header's
names, and the table's columns are the union of all header names, taken from
the objects by path. The plan has the same size for two files or two
thousand.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .csv_folder import header_names
from .csv_split import CSV_OPTIONS, csv_records

# A quoted field, so that separators inside quotes are not counted.
_QUOTED = r'"([^"]|"")*"'


def field_count(record: Column) -> Column:
    """The number of fields of a CSV record."""
    bare = F.regexp_replace(record, _QUOTED, "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def variant_path(name: str) -> str:
    """A ``variant_get`` path to the key ``name``."""
    if "'" not in name:
        return "$['" + name.replace("\\", "\\\\") + "']"
    return '$["' + name.replace("\\", "\\\\") + '"]'


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Header cells to column names: blanks numbered, repeats suffixed, without case."""
    for batch in batches:
        names = [header_names(cells or [], ignore_case=True) for cells in batch.column("cells").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(names, pa.list_(pa.string()))],
                                         ["file", "names"])


def load_wide_variant(spark: SparkSession, paths: list[str], block_bytes: int | None = None) -> DataFrame:
    """One table of the rows of all files: the union of their columns in order of first sighting (by path, then
    position), a column a file lacks NULL, then ``sheet_name`` (the file's stem) and ``row`` (VARIANT).

    Cells are text, an empty one NULL; a blank header cell is named ``Unnamed: i``, a repeated
    name gets ``.1``, ``.2`` (without case); names of different files that
    differ only in case are one column, spelled as first seen; a row with more fields than its
    header keeps only as many. A file without rows adds its columns only. A
    name holding both kinds of quote cannot be a VARIANT path and is an error.
    """
    records = stage(csv_records(spark, paths, block_bytes).filter(F.col("record") != ""))
    heads = records.filter("is_header").select("file", "record")
    width = heads.agg(F.max(field_count(F.col("record")))).first()[0] or 0
    schema = ", ".join(f"c{i} string" for i in range(width))
    cells = heads.select("file", F.from_csv("record", schema, CSV_OPTIONS).alias("r"), field_count(F.col("record")).alias("n"))
    cells = cells.select("file", F.slice(F.array(*[F.col(f"r.c{i}") for i in range(width)]), 1, F.col("n")).alias("cells"))
    named = stage(cells.mapInArrow(_named, "file string, names array<string>"))
    # the union of the names: as many rows as distinct names, the output's own schema
    first_seen = named.select("file", F.posexplode("names").alias("pos", "name")).groupBy(F.lower("name").alias("key")) \
        .agg(F.min(F.struct("file", "pos", "name")).alias("at")).orderBy("at").collect()
    columns = [r.at.name for r in first_seen]
    # names are case-blind, as Spark's columns: each takes the spelling seen first
    spelling = F.create_map(*[F.lit(x) for r in first_seen for x in (r.key, r.at.name)]) if first_seen else None
    canonical = named.select("file", F.transform("names", lambda n: F.element_at(spelling, F.lower(n))).alias("names")) \
        if first_seen else named
    rows = records.filter(~F.col("is_header")).join(canonical, "file")
    values = F.from_csv("record", schema, CSV_OPTIONS)
    parsed = rows.select("file", "names", values.alias("r"))
    obj = F.map_from_arrays("names", F.slice(F.array(*[F.col(f"r.c{i}") for i in range(width)]), 1, F.size("names")))
    wide = parsed.select(F.parse_json(F.to_json(obj)).alias("row"), "file")
    name = F.replace(F.element_at(F.split("file", "/"), -1), F.lit("+"), F.lit("%2B"))
    stem = F.regexp_replace(F.url_decode(name), r"\.[^.]*$", "")
    return wide.select(*[F.variant_get("row", variant_path(c), "string").alias(c) for c in columns],
                       stem.alias("sheet_name"), "row")
