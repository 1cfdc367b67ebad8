"""Column helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"\x20\x09-\x0D"                    # ASCII white space, inside [...]
SPACED_WORD = rf"[^{SPACE}]+"


def whole(text: Column) -> Column:
    """The text, NULL read as empty."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand whole texts to Python at most ``rows`` at a time, since each may be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def release_memory() -> None:
    """Hand memory that this process has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(source: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` whose tasks hand back their memory: the Python worker outlives them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release_memory()

    return source.mapInArrow(run, schema)
