"""Folder listing."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, folder: str, extension: str) -> list[str]:
    """Paths of the files directly in ``folder`` with the extension in any case,
    sorted by name; names containing "processed" are left out. Contents are not read."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in extension)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    paths = listed.filter(~F.contains(name, F.lit("processed"))).select("path").collect()
    return sorted(r["path"] for r in paths)


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")
