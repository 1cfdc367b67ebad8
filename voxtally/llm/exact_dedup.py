"""Exact deduplication by content-defined chunk recipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .text import SPACE, whole


def _byte_class(step: int) -> str:
    """A regular-expression class of half of all bytes, another half for each step."""
    return "[" + "".join(f"\\x{b:02x}" for b in range(256) if (b + 1) * step % 257 % 2) + "]"


def chunk_pattern(least: int = 256, most: int = 8192) -> str:
    """Cut behind the first boundary of ten bytes past ``least``, at ``most`` without one.

    The bytes decide where a chunk ends, after 1024 more on average, so equal
    passages fall into equal chunks soon after they begin, wherever they stand.
    """
    boundary = "".join(_byte_class(3 + 22 * i) for i in range(10))
    return f"(?s).{{{least - 10},{most - 10}}}?{boundary}|.{{1,{most}}}"


def normalised(text: Column) -> Column:
    """The text without ASCII white space; NULL counts as empty."""
    return F.regexp_replace(whole(text), f"[{SPACE}]+", "")


def content_chunks(text: Column, least: int = 256, most: int = 8192) -> Column:
    """The chunks of a text's UTF-8 bytes, each byte as one character; none for an empty text."""
    as_bytes = F.decode(text.cast("binary"), "ISO-8859-1")
    return F.regexp_extract_all(as_bytes, F.lit(chunk_pattern(least, most)), F.lit(0))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of texts that are identical without white space, one row per input row.

    ``doc_id, keep_id, group_size, kept, text_sha256``: of equal texts the one
    with the most code points, then the smallest id, stays (a NULL id comes
    last). NULL counts as empty; all blank texts are equal. Rows repeated with
    one id are counted as they are and share its ``kept``. Other columns are
    ignored; an empty table gives an empty one.

    A text is moved once, chunk by chunk, to verify that chunks with one
    identifier have the same bytes; equal chunks of a task travel once. From
    there on only identifiers move: texts are equal when their ordered
    identifier lists are. Should two different chunks share a 128-bit
    identifier, the pass is repeated with the next seed.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    body = source.select("doc_id", F.length(whole(F.col("text"))).alias("n_chars"),
                         normalised(F.col("text")).alias("body"))
    cut = content_chunks(F.col("body"))
    pieces = body.select(F.explode_outer(cut).alias("chunk")).filter(F.col("chunk").isNotNull())
    seed = 0
    while True:
        def name(chunk: Column, seed: int = seed) -> tuple[Column, Column]:
            return F.xxhash64(F.lit(seed), chunk), F.xxhash64(chunk, F.lit(seed))

        high, low = name(F.col("chunk"))
        clashes = (pieces.groupBy(high.alias("high"), low.alias("low"))
                   .agg(F.min("chunk").alias("one"), F.max("chunk").alias("other"))
                   .filter("one <> other"))
        if clashes.count() == 0:
            break
        seed += 1
    recipe = F.flatten(F.transform(cut, lambda c: F.array(*name(c))))
    listed = stage(body.select("doc_id", "n_chars", F.sha2(F.col("body"), 256).alias("text_sha256"),
                               recipe.alias("recipe")))
    best = F.min(F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), F.col("doc_id").alias("id")))
    # written first, so that the join below can split a recipe of many copies
    groups = stage(listed.groupBy("recipe").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")))
    return (listed.join(groups, "recipe")
            .select("doc_id", F.col("best.id").alias("keep_id"), "group_size",
                    F.col("doc_id").eqNullSafe(F.col("best.id")).alias("kept"), "text_sha256"))
