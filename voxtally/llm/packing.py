"""Packing into length buckets with the least padding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_table, stage
from .text import SPACED_WORD, map_arrow, whole
from .token_files import token_lengths


def word_length(text: Column) -> Column:
    """Words of a whole text: the length measure of ``pack`` unless it is given another."""
    return F.regexp_count(whole(text), F.lit(SPACED_WORD)).cast("long")


def pack_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``pack`` with documents measured in tokens of the tokenizer file ``path``.

    ``start``, ``n``, ``bucket`` and the budget of a batch then count tokens; the
    whole text is encoded, no end id is counted.
    """
    return pack(token_lengths(docs, path, doc_id, text), length=F.col("n_tokens"), **options)


def best_boundaries(counts: dict[int, int], buckets: int) -> list[int]:
    """At most ``buckets`` upper bounds that minimise the padding of a length histogram.

    Dynamic programming over the lengths that occur: ``cost[j]`` is the least
    padding of the first ``j`` lengths, a last bucket over ``i..j`` pads every
    item up to length ``j``. Of equal costs the leftmost cut is taken.
    """
    lengths = np.array(sorted(counts), dtype=np.int64)
    if not len(lengths):
        return []
    items = np.concatenate([[0], np.cumsum([counts[int(x)] for x in lengths])])
    size = np.concatenate([[0], np.cumsum([counts[int(x)] * int(x) for x in lengths])])
    n = len(lengths)
    cost = np.where(np.arange(n + 1) == 0, 0, np.iinfo(np.int64).max // 4)
    cuts = []
    for _ in range(min(buckets, n)):
        new, cut = cost.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            options = cost[:j] + lengths[j - 1] * (items[j] - items[:j]) - (size[j] - size[:j])
            i = int(np.argmin(options))
            if options[i] < new[j]:
                new[j], cut[j] = options[i], i
        cost = new
        cuts.append(cut)
    bounds, j = [], n
    for cut in reversed(cuts):
        if j and cut[j] >= 0:
            bounds.append(int(lengths[j - 1]))
            j = int(cut[j])
    return sorted(bounds)


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: Column | None = None,
         max_length: int = 2048, buckets: int = 8, batch_tokens: int = 65_536) -> DataFrame:
    """Cut documents into pieces and the pieces into padded batches.

    One row per piece: ``doc_id, piece, start, n, bucket, batch, slot``. A
    document of more than ``max_length`` units is cut into full pieces and a
    rest; an empty or NULL one is one piece of length 0. ``bucket`` is the
    padded length: the smallest of at most ``buckets`` boundaries that holds
    the piece; the boundaries minimise padding over the histogram of all
    pieces, which has at most ``max_length + 1`` entries. Batches hold
    ``batch_tokens // bucket`` pieces of one bucket (at least one), in order of
    id; only a bucket's last batch is smaller. ``length`` measures a document,
    words by default. Rows repeated with one id are packed each; among them
    the order is that of their pieces and lengths. Other columns are ignored.
    """
    measured = docs.select(F.col(doc_id).alias("doc_id"),
                           F.coalesce(word_length(F.col(text)) if length is None else length.cast("long"),
                                      F.lit(0)).alias("total"))
    last = F.greatest(F.ceil(F.col("total") / max_length).cast("long") - 1, F.lit(0))
    pieces = (measured.select("doc_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
              .withColumn("start", F.col("piece") * max_length)
              .withColumn("n", F.least(F.col("total") - F.col("start"), F.lit(max_length).cast("long"))))
    pieces = stage(pieces.select("doc_id", "piece", "start", "n"))
    counts = {r["n"]: r["c"] for r in pieces.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    bounds = best_boundaries(counts, buckets)
    bucket = F.lit(max_length)
    for b in reversed(bounds):
        bucket = F.when(F.col("n") <= b, b).otherwise(bucket)
    placed = pieces.withColumn("bucket", bucket.cast("long"))
    return _number(placed, batch_tokens)


def _number(placed: DataFrame, batch_tokens: int) -> DataFrame:
    """Batches and slots: a range sort, the sizes of its parts, and each part's own count."""
    order = ["bucket", "doc_id", "piece", "n"]
    spark = placed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .withColumn("part", F.spark_partition_id()))
    schema = T.StructType([*ranged.schema.fields, T.StructField("at", T.LongType())])

    def count_up(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            at = np.empty(len(buckets), dtype=np.int64)
            for b in np.unique(buckets):
                rows = np.flatnonzero(buckets == b)
                at[rows] = seen.get(b, 0) + np.arange(len(rows))
                seen[b] = seen.get(b, 0) + len(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "at"])

    numbered = stage(map_arrow(ranged, count_up, schema))
    # one row per part and bucket: bounded by the partitions, not by the data
    sizes = numbered.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("size")).collect()
    before: dict[tuple[int, int], int] = {}
    running: dict[int, int] = {}
    for r in sorted(sizes):
        before[r["bucket"], r["part"]] = running.get(r["bucket"], 0)
        running[r["bucket"]] = running.get(r["bucket"], 0) + r["size"]
    offsets = small_table(spark, [(*key, n) for key, n in before.items()],
                          bucket=pa.int64(), part=pa.int32(), before=pa.int64())
    place = F.col("at") + F.col("before")
    room = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.greatest("bucket", F.lit(1))))
    return (numbered.join(offsets, ["bucket", "part"])
            .select("doc_id", "piece", "start", "n", "bucket",
                    F.floor(place / room).alias("batch"), (place % room).alias("slot")))
