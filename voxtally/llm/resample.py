"""Target-distribution importance resampling, ranked by parallel sorting by regular sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..session import stage
from .text import ascii_lower, whole

ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"   # letters, digits and every non-ASCII character


def words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; NULL has none."""
    return F.regexp_extract_all(ascii_lower(whole(text)), F.lit(ITEM_WORD), F.lit(0))


def features(tokens: Column, longest: int = 1) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by one space, repeats kept."""
    if longest == 1:
        return tokens

    def shifted(w: Column, k: int) -> Column:
        return F.slice(w, k, F.greatest(F.size(w) - k + 1, F.lit(0)))

    def runs(w: Column) -> Column:
        # runs of k from runs of k - 1 and the words k - 1 places on: linear in the words
        out, previous = [w], w
        for k in range(2, longest + 1):
            previous = F.zip_with(F.slice(previous, 1, F.greatest(F.size(previous) - 1, F.lit(0))), shifted(w, k),
                                  lambda a, b: F.concat(a, F.lit(" "), b))
            out.append(previous)
        return F.concat(*out)
    return let(tokens, runs)     # the words once a row, not once a run


def bucket(feature: Column, buckets: int) -> Column:
    """Unsigned crc32 of the UTF-8 bytes, modulo ``buckets``."""
    return F.crc32(F.encode(feature, "UTF-8")) % buckets


def bucket_gains(docs: DataFrame, targets: DataFrame, buckets: int) -> DataFrame:
    """One row: ``gains``, an array of ``buckets`` log-ratios of the target's to the corpus's bucket shares.

    ``floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B))))`` with ``s``, ``t``
    the features of a bucket in the corpus and the targets, ``S``, ``T`` all of
    them and ``B`` the number of buckets. Counts are combined map-side, so a
    bucket holding most features moves one partial count per task; the row has
    ``buckets`` longs, a size set by the parameter, never by the data.
    """
    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode("_buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))

    spark = docs.sparkSession
    every = spark.range(buckets).select(F.col("id").alias("bucket"))
    table = every.join(counts(docs, "s"), "bucket", "left").join(counts(targets, "t"), "bucket", "left") \
        .fillna(0, ["s", "t"])
    totals = Window.partitionBy()      # over ``buckets`` rows: the parameter bounds this one task
    with_totals = table.select("bucket", "s", "t", F.sum("s").over(totals).alias("s_all"),
                               F.sum("t").over(totals).alias("t_all"))
    s, t, S, T = (F.col(c).cast("double") for c in ("s", "t", "s_all", "t_all"))   # names are case-blind
    gain = F.floor(1000 * F.log((t + 1) * (S + buckets) / ((s + 1) * (T + buckets))))
    return with_totals.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", gain.alias("gain")))),
                                       lambda e: e["gain"]).alias("gains"))


def gumbel(doc_id: Column, seed: str) -> Column:
    """``floor(-1000 * ln(-ln((h + 0.5) / 2^32)))``, h the first 8 hex digits of sha256(``seed:doc_id``)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_resample(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text",
                        target_text: str = "text", longest: int = 1, buckets: int = 10_000, percent: int = 10,
                        least_words: int = 20, seed: str = "2024") -> DataFrame:
    """Draw ``percent`` of the documents that look most like ``targets``; one row per input row.

    Returns ``doc_id, n_words, n_features, weight, score, rank`` (all long).
    Words are ``ITEM_WORD`` runs of the A-Z lower-cased text; features all runs
    of 1 to ``longest`` words. ``weight`` is the sum of the bucket gains of a
    document's features (``bucket_gains``; 0 without features); ``score`` adds a
    Gumbel key from the id, so that taking the highest scores draws without
    replacement in proportion to exp(weight / 1000). Of the N rows with at least
    ``least_words`` words, the ``floor(percent * N / 100)`` highest scores get
    ranks 1, 2, ... (ties to the smaller id, then to the earlier of repeated
    rows); every other row has rank NULL.

    NULL text has no words; a NULL id has score and rank NULL and is not one of
    the N. Repeated rows are ranked one by one. Other columns are ignored. An
    empty table gives an empty one; empty ``targets`` leave only the corpus
    counts in the gains.

    The weights are computed inside each row from the ``buckets`` gains,
    which the plan holds as a literal. Ranks are exact and spread over all tasks: ``exact_ranks``.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), words(F.col(text)).alias("_words"))
    listed = source.select("doc_id", F.size("_words").alias("n_words"),
                           features(F.col("_words"), longest).alias("_features"))
    with_buckets = listed.select("doc_id", "n_words", F.size("_features").cast("long").alias("n_features"),
                                 F.transform("_features", lambda f: bucket(f, buckets)).alias("_buckets"))
    corpus = stage(with_buckets)
    aims = targets.select(F.transform(features(words(F.col(target_text)), longest),
                                      lambda f: bucket(f, buckets)).alias("_buckets"))
    # ``buckets`` longs, a size the parameter sets: they go into the plan as one literal array
    gains = F.lit(np.array(bucket_gains(corpus, aims, buckets).first()["gains"], dtype=np.int64))
    weight = F.aggregate(F.col("_buckets"), F.lit(0).cast("long"),
                         lambda acc, b: acc + F.element_at(gains, (b + 1).cast("int")))
    scored = corpus.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_features", weight.alias("weight"))
    scored = scored.withColumn("score", (F.col("weight") + gumbel(F.col("doc_id"), seed)).cast("long"))
    scored = stage(scored.withColumn("_row", F.monotonically_increasing_id()))
    eligible = scored.filter((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull())
    draws = percent * eligible.count() // 100
    ranked = exact_ranks(eligible.select("_row", (-F.col("score")).alias("_k1"), F.col("doc_id").alias("_k2")),
                         ["_k1", "_k2", "_row"])
    drawn = ranked.filter(F.col("rank") <= draws).select("_row", "rank")
    return scored.join(drawn, "_row", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def _ordered_keys(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Long keys as fixed-width big-endian bytes with the sign flipped: byte order is key order."""
    parts = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
             for k in keys]
    matrix = np.stack(parts, axis=1).astype(">u8")    # stacking first: it would give back the native order
    return np.ascontiguousarray(matrix).view(f"S{8 * len(keys)}").ravel()


def exact_ranks(df: DataFrame, keys: list[str], ranges: int | None = None, oversample: int = 4) -> DataFrame:
    """``df`` with ``rank`` 1, 2, ... in ascending order of the long columns ``keys``, which must be unique and not NULL.

    Parallel sorting by regular sampling: each partition is sorted locally and
    gives keys at regular positions of its run, about ``oversample * ranges``
    in all (a number set by partition counts, never by rows); from their
    order ``ranges - 1`` splitters are taken at regular positions. Rows go to
    their range by binary search (vectorised), each range is sorted where it
    lands, and the sizes of the ranges, added up in order, give each range
    its first rank. Regular samples of sorted runs keep every range within a
    small multiple of its share, so no task holds a hot key's rows.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = df.select(*keys).sortWithinPartitions(*keys)
    per_run = max(1, math.ceil(oversample * ranges / max(1, runs.rdd.getNumPartitions())))
    width = 8 * len(keys)

    def regular(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sorted_keys = [_ordered_keys(b, keys) for b in batches]   # 8 bytes a key: the run's keys, not its rows
        run = np.concatenate(sorted_keys) if sorted_keys else np.empty(0, f"S{width}")
        if len(run):
            picks = run[np.unique(np.arange(per_run) * len(run) // per_run)]
            yield pa.RecordBatch.from_arrays([pa.array(picks.tolist(), pa.binary())], ["key"])

    samples = sorted(r.key for r in runs.mapInArrow(regular, "key binary").collect())
    splitters = np.array(sorted(set(samples[i * len(samples) // ranges] for i in range(1, ranges))) if samples else [],
                         dtype=f"S{width}")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            where = np.searchsorted(splitters, _ordered_keys(b, keys), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(where)], [*b.schema.names, "_range"])

    schema = f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, _range int"
    placed = stage(df.mapInArrow(place, schema))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row a range: ``ranges`` rows at most, a size set by the parameter
    firsts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_first"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return placed.join(F.broadcast(firsts), "_range").select(*df.columns, (F.col("_first") + within).alias("rank"))
