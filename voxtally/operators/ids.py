"""Dense ids without a single-task window."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import bounded_rows, small_table, stage

_ROW_BITS = 33   # monotonically_increasing_id keeps the row number in its low bits


def dense_index(df: DataFrame, *order: Column | str, out: str = "row_id",
                within: str | None = None) -> DataFrame:
    """Number rows 1..n in the given order, which must be unique.

    The rows are range-partitioned and sorted once and written with their
    position inside the partition; the id is that position plus the number of
    rows in earlier partitions. Only the per-partition counts (as many rows as
    there are partitions) meet in one place. With ``within`` (a column that
    leads the order) numbering restarts per value, still without putting a
    large group into one task.
    """
    keys = ([F.col(within)] if within else []) + list(order)
    local = F.monotonically_increasing_id()
    low = local.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    placed = stage(df.orderBy(*keys).select(
        "*", F.spark_partition_id().alias("__part"), low.alias("__at")))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    # one row per partition: small by construction
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    numbered = placed.join(F.broadcast(offsets), "__part").withColumn(
        out, F.col("__off") + F.col("__at") + 1)
    if within:
        firsts = numbered.groupBy(within).agg(F.min(out).alias("__first"))
        # a null-safe join would lose the hash join, so nulls are not groups here
        numbered = numbered.join(stage(firsts), within).withColumn(
            out, F.col(out) - F.col("__first") + 1).drop("__first")
    return numbered.drop("__part", "__at", "__off")


def response_ids(df: DataFrame, *order: Column | str, out: str = "response_id") -> DataFrame:
    """Running id from 1 over the given order."""
    return dense_index(df, *order, out=out)


def first_seen_ids(df: DataFrame, value: str, row_id: str, out: str) -> DataFrame:
    """Add the rank of each distinct value by its earliest row.

    The distinct values are found with map-side partial aggregation. A few are
    ranked here and broadcast; many are numbered by a range sort and joined back
    as a staged table, which the optimizer broadcasts by its real size or
    sort-merges with AQE splitting a hot value.
    """
    firsts = df.groupBy(value).agg(F.min(row_id).alias("__first"))
    few = bounded_rows(firsts)
    if few is not None:
        seen = [r[value] for r in sorted(few, key=lambda r: r["__first"])]
        kind = to_arrow_type(df.schema[value].dataType)
        ranks = small_table(df.sparkSession, list(zip(seen, range(1, len(seen) + 1))),
                            **{value: kind, out: pa.int32()})
        return df.join(F.broadcast(ranks), value, "left")   # at most INLINE_LIMIT rows
    ranked = dense_index(firsts, "__first", out="__rank").select(
        value, F.col("__rank").cast("int").alias(out))
    return df.join(stage(ranked), value, "left")
