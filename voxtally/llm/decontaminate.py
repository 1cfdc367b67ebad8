"""Benchmark decontamination by a prefix-filtered join of word windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .text import ascii_lower, whole

# Word characters are ASCII letters and digits and all beyond ASCII. The others
# are listed one by one: the JVM tests a list by one bit, ranges one by one.
WORD = "[^" + "".join(f"\\x{c:02x}" for c in range(128) if not chr(c).isalnum()) + "]+"


def words_of(text: Column) -> Column:
    """Words with their letters' case as it stands; NULL has none."""
    return F.regexp_extract_all(whole(text), F.lit(WORD), F.lit(0))


def _shingle(words: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from the 0-based place ``at``, NULL past the end.

    Letters are folded by ``lower``: equal words have equal hashes, and the
    exact comparison follows on the words themselves.
    """
    parts = [F.lower(F.get(words, at + i)) for i in range(size)]
    return F.when(at + size <= F.size(words), F.xxhash64(F.lit(size), *parts))


def item_windows(items: DataFrame, window: int, item_id: str = "item_id",
                 text: str = "text") -> DataFrame:
    """Distinct ``win, n, item``: every run of ``window`` words, or the whole shorter item.

    ``win`` is the words, A-Z lower-cased, joined by spaces.
    """
    worded = items.select(F.col(item_id).alias("item"), words_of(ascii_lower(F.col(text))).alias("words"))
    long_enough = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    cut = F.slice(F.col("words"), F.col("at") + 1, window)
    return (worded.select("item", "words", F.explode_outer(long_enough).alias("at"))
            .filter(F.size("words") > 0)
            .select(F.array_join(cut, " ").alias("win"), F.size(cut).alias("n"), "item").distinct())


def _doc_shingles(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, words, at, h`` for each shingle of a document."""
    worded = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    # the outer form: the inner one would evaluate the words twice
    return (worded.select("doc_id", "words", F.posexplode_outer("words").alias("at", "_w"))
            .select("doc_id", "words", "at", _shingle(F.col("words"), F.col("at"), size).alias("h")))


def benchmark_hits(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3,
                   doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                   item_text: str = "text") -> DataFrame:
    """Every place where an item's window stands in a document: ``doc_id, start, n, item``.

    A set join with containment 1. Windows are sets of ``shingle``-word
    shingles, ordered by how often the corpus has them; since all must be
    present, the rarest one is the whole necessary prefix. Documents are joined
    on it, a hit fixes where the window must begin and end, windows outside the
    document are dropped, and the words are compared exactly. A window with a
    shingle that no document has is not looked for. The tables of shingles are
    written first, so they are broadcast only while they are small.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    windows = stage(item_windows(items, window, item_id, item_text))
    found = []
    # windows shorter than a shingle are one shingle of their own length
    for size in sorted(r["size"] for r in windows.select(
            F.least("n", F.lit(shingle)).alias("size")).distinct().collect()):
        own = windows if size == shingle else windows.filter(F.col("n") == size)
        own = own.filter(F.col("n") >= size)
        split = F.split(F.col("win"), " ")
        parts = (own.select("win", "n").distinct()
                 .select("win", "n", split.alias("words"),
                         F.explode(F.sequence(F.lit(0), F.col("n") - size)).alias("offset"))
                 .select("win", "n", "offset", _shingle(F.col("words"), F.col("offset"), size).alias("h")))
        parts = stage(parts)
        wanted = stage(parts.select("h").distinct())
        counts = stage(_doc_shingles(source, size).select("h").join(wanted, "h", "left_semi")
                       .groupBy("h").agg(F.count(F.lit(1)).alias("df")))
        rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("h"), F.col("offset")))
        prefixes = stage(parts.join(counts, "h", "left").groupBy("win", "n").agg(rarest.alias("p"))
                         .filter("p.df > 0").select("win", "n", "p.h", "p.offset"))
        tokens = stage(prefixes.select("h").distinct())
        reach = window - size
        low = F.greatest(F.col("at") - reach, F.lit(0))
        near = (_doc_shingles(source, size).join(tokens, "h", "left_semi")
                .select("doc_id", "h", "at", low.alias("low"), F.size("words").alias("n_words"),
                        F.slice(F.col("words"), low + 1, 2 * window).alias("near")))
        start = F.col("at") - F.col("offset")
        there = ascii_lower(F.array_join(F.slice(F.col("near"), start - F.col("low") + 1, F.col("n")), " "))
        found.append(near.join(prefixes, "h")
                     .filter((start >= 0) & (start + F.col("n") <= F.col("n_words")))
                     .filter(there == F.col("win"))
                     .select("doc_id", start.alias("start"), "win", "n"))
    if not found:
        empty = windows.limit(0).crossJoin(source.limit(0))
        return empty.select("doc_id", F.lit(0).alias("start"), "n", "item")
    hits = reduce(DataFrame.unionByName, found)
    return hits.join(windows.select("win", "item"), "win").select("doc_id", "start", "n", "item")


def covered(spans: Column) -> Column:
    """Places covered by an array of ``struct<start, stop>``, overlaps counted once."""
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("upto"))
    return F.aggregate(F.sort_array(spans), zero, lambda acc, s: F.struct(
        (acc["total"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], acc["upto"]))).alias("total"),
        F.greatest(acc["upto"], s["stop"]).alias("upto")))["total"]


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 3,
                  doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """What each document shares with a benchmark, one row per input row.

    ``doc_id, n_words, n_hit, item_ids, contaminated``: words inside any
    occurrence of an item's window, and the items that occur, as sorted
    strings. NULL and empty texts have no words; items without words are never
    found; a NULL item id is left out of ``item_ids`` but its windows are hit.
    Rows repeated with one id are judged together: each gets the hits of all.
    A NULL id is an id. Other columns are ignored.
    """
    hits = benchmark_hits(docs, items, window, shingle, doc_id, text, item_id, item_text)
    spans = F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop")))
    per_doc = (hits.groupBy("doc_id")
               .agg(spans.alias("spans"), F.collect_set(F.col("item").cast("string")).alias("items"))
               .select(F.col("doc_id").alias("_id"), covered(F.col("spans")).alias("n_hit"),
                       F.sort_array("items").alias("item_ids")))
    counted = docs.select(F.col(doc_id).alias("doc_id"),
                          F.regexp_count(whole(F.col(text)), F.lit(WORD)).alias("n_words"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0))
    return (counted.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
            .select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"),
                    F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                    (n_hit > 0).alias("contaminated")))
