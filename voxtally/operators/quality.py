"""Checks of a response table against the input contract."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, is_blank
from ..session import small_table
from .reshape import quoted

REQUIRED = ("survey_id", "question_id", "question_text", "response_id", "response_text",
            "Timestamp")
OPTIONAL = ("survey_source", "email")
ID_COLUMNS = ("survey_id", "question_id", "response_id")
TEXT_COLUMNS = ("question_text", "response_text", "survey_source", "email")

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
_INT_TEXT = rf"^[{SPACE}]*[+-]?\d+[{SPACE}]*$"


@dataclass(frozen=True)
class Validation:
    passed: bool
    report: DataFrame      # check, column, severity, n
    converted: DataFrame   # input with Timestamp as a timestamp; input itself is unchanged


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in REQUIRED if c not in df.columns]


def type_findings(df: DataFrame) -> list[tuple[str, str, str]]:
    """``(check, column, severity)`` from the schema alone; no job runs."""
    types = {f.name: f.dataType for f in df.schema}
    found = []
    for c in ID_COLUMNS:
        if c in types and not isinstance(types[c], _INTEGERS):
            numeric = isinstance(types[c], T.NumericType)
            found.append(("id_type", c, "warn" if numeric else "error"))
    for c in TEXT_COLUMNS:
        if c in types and not isinstance(types[c], T.StringType):
            found.append(("text_type", c, "warn"))
    return found


def bad_id(c: str) -> Column:
    """A value of a text id column that is not an integer."""
    return F.col(c).isNotNull() & ~F.col(c).cast("string").rlike(_INT_TEXT)


def bad_timestamp(c: str) -> Column:
    return F.col(c).isNotNull() & F.try_to_timestamp(F.col(c).cast("string")).isNull()


def missing(c: str) -> Column:
    return quoted(c).isNull()


def empty(c: str) -> Column:
    """Blank text; NULL is missing, not empty."""
    return quoted(c).isNotNull() & is_blank(quoted(c).cast("string"))


def _content_aggregates(df: DataFrame) -> list[Column]:
    aggs = [F.count("*").alias("total")]
    if "question_text" in df.columns:
        aggs.append(F.count_if(missing("question_text")).alias("missing_question_text"))
    if "response_text" in df.columns:
        aggs += [F.count_if(missing("response_text")).alias("missing_response_text"),
                 F.count_if(empty("response_text")).alias("empty_response_text")]
    if "email" in df.columns:
        aggs.append(F.count("email").alias("with_email"))
    return aggs


def content_counts(df: DataFrame) -> DataFrame:
    """One row: missing and empty texts and e-mail coverage, in one pass."""
    return df.agg(*_content_aggregates(df))


def source_distribution(df: DataFrame, source: str = "survey_source") -> DataFrame:
    """Rows per source, NULL being one of them."""
    return df.groupBy(source).agg(F.count("*").alias("n"))


def validate(df: DataFrame) -> Validation:
    """Structure decides the verdict; content only adds warnings.

    One schema check on the driver and one aggregate job.
    """
    findings = [("required_column", c, "error", 1) for c in missing_columns(df)]
    findings += [(*f, 1) for f in type_findings(df)]
    timed = "Timestamp" in df.columns and not isinstance(df.schema["Timestamp"].dataType, _TIMES)
    aggregates = _content_aggregates(df)
    if timed:
        aggregates.append(F.count_if(bad_timestamp("Timestamp")).alias("bad_timestamp"))
    values = df.agg(*aggregates).first().asDict()
    if values.get("bad_timestamp"):
        findings.append(("timestamp", "Timestamp", "error", values["bad_timestamp"]))
    passed = not any(f[2] == "error" for f in findings)
    if passed:
        for check, column in (("missing", "question_text"), ("missing", "response_text"),
                              ("empty", "response_text")):
            n = values.get(f"{check}_{column}", 0)
            if n:
                findings.append((check, column, "warn", n))
        if "with_email" in values:
            findings.append(("coverage", "email", "info", values["with_email"]))
    converted = df
    if timed and passed:
        converted = df.withColumn("Timestamp", F.to_timestamp("Timestamp"))
    report = small_table(df.sparkSession, findings, check=pa.string(), column=pa.string(),
                         severity=pa.string(), n=pa.int64())
    return Validation(passed, report, converted)
