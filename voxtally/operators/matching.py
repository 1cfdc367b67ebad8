"""Whole-word matches of a keyword list in texts.

A short list is inlined and tested inside the row (no shuffle, cost independent
of the list's length). A longer list stays a table: run n-grams of the texts
are hash-joined to it, which the optimizer broadcasts only if it is small.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_rows
from ..functions.text import (MATCH_WORD, RUN, SPACE, matching_keywords, normalise_keywords,
                              replace_words, run_ngrams, strip)
from ..session import INLINE_LIMIT, bounded_rows, small_table, stage

ANCHOR_RUNS = 7

Keywords = Sequence[str] | DataFrame   # a list, or a table (pos, keyword)


def named_keywords(df: DataFrame, keywords: Keywords) -> DataFrame:
    """``(keyword, pos, spelling)``: trimmed and lower-cased, blanks and NULLs gone,
    of equal ones the first.

    Applied before the size is looked at, so that short and long lists follow
    the same rule.
    """
    if not isinstance(keywords, DataFrame):
        keywords = small_table(df.sparkSession, list(enumerate(keywords)), pos=pa.int64(), keyword=pa.string())
    named = keywords.select("pos", F.col("keyword").alias("spelling"), strip(F.lower("keyword")).alias("keyword"))
    return named.filter("keyword <> ''").groupBy("keyword").agg(
        F.min("pos").alias("pos"), F.min_by("spelling", "pos").alias("spelling"))


def inline_keywords(df: DataFrame, keywords: Keywords) -> dict[str, str] | None:
    """Normalised keyword -> first spelling, in list order, if short enough to
    inline, else None."""
    if not isinstance(keywords, DataFrame) and len(keywords) <= INLINE_LIMIT and all(
            k is not None and k.isascii() for k in keywords):
        # plain words need no job: both ways of trimming and lower-casing agree
        spelling: dict[str, str] = {}
        for keyword in keywords:
            spelling.setdefault(keyword.strip().lower(), keyword)
        return {norm: spelling[norm] for norm in normalise_keywords(list(spelling))}
    rows = bounded_rows(named_keywords(df, keywords), INLINE_LIMIT)
    return None if rows is None else {r["keyword"]: r["spelling"] for r in sorted(rows, key=lambda r: r["pos"])}


def _inline_matches(text: str, listed: dict[str, str], spelled: bool) -> Column:
    found = matching_keywords(F.col(text), list(listed))
    changed = {k: v for k, v in listed.items() if k != v}
    return replace_words(found, changed) if spelled else found


def _pattern(span: str) -> Column:
    """Whole-word regular expression of a keyword column."""
    word, other = rf"[{MATCH_WORD}]", rf"[^{MATCH_WORD}]"
    body = F.regexp_replace(span, rf"([^{MATCH_WORD}{SPACE}])", r"\\$1")
    return F.concat(
        F.when(F.col(span).rlike(f"^{word}"), f"(^|{other})").otherwise(word), body,
        F.when(F.col(span).rlike(f"{word}$"), f"($|{other})").otherwise(word))


def listed_prefixes(table: DataFrame) -> dict[int, dict[str, bool]]:
    """By number of runs, the beginnings of the spans and whether one is a whole span.

    From one run up to ANCHOR_RUNS, as many as fit into INLINE_LIMIT beginnings
    in all; longer ones are left to the join.
    """
    runs = F.regexp_extract_all(F.col("span"), F.lit(RUN), F.lit(0))
    starts = (table.select("size", runs.alias("runs"), F.explode(F.sequence(F.lit(1), F.col("size"))).alias("level"))
              .groupBy("level", F.array_join(F.slice("runs", 1, F.col("level")), "").alias("prefix"))
              .agg(F.bool_or(F.col("size") == F.col("level")).alias("whole")))
    # at most ANCHOR_RUNS rows
    room, deepest = INLINE_LIMIT, 0
    for r in starts.groupBy("level").count().orderBy("level").collect():
        room -= r["count"]
        if room < 0:
            break
        deepest = r["level"]
    listed: dict[int, dict[str, bool]] = {}
    for r in starts.filter(F.col("level") <= deepest).collect():
        listed.setdefault(r["level"], {})[r["prefix"]] = r["whole"]
    return listed


def matches_joined(df: DataFrame, keywords: Keywords, text: str, key: str) -> DataFrame:
    """``(key, pos, keyword, spelling)`` per match, by a join with the keyword table.

    A keyword is joined on its first ANCHOR_RUNS runs (four words), which is all
    of nearly every keyword; a longer one is then verified on the few texts that
    hold its anchor.
    """
    runs = F.regexp_extract_all(F.col("keyword"), F.lit(RUN), F.lit(0))
    word = rf"^[{MATCH_WORD}]"
    table = stage(named_keywords(df, keywords).withColumns({
        "long": F.size(runs) > ANCHOR_RUNS,
        "size": F.least(F.size(runs), F.lit(ANCHOR_RUNS)),
        "span": F.array_join(F.slice(runs, 1, ANCHOR_RUNS), ""),
        "need_lead": ~F.col("keyword").rlike(word),
        "need_trail": ~F.reverse("keyword").rlike(word)}))
    # sizes present: at most ANCHOR_RUNS rows
    found = table.groupBy("size").agg(F.bool_or("long").alias("long")).orderBy("size").collect()
    grams = explode_rows(df, [key], run_ngrams(
        F.col(text), [r["size"] for r in found], listed_prefixes(table)), "g")
    hits = (grams.select(key, "g.*").join(table, "span")
            .filter((~F.col("need_lead") | F.col("lead"))
                    & (~F.col("need_trail") | F.col("trail") | F.col("long")))
            .select(key, "pos", "keyword", "spelling", "long").distinct())
    if not any(r["long"] for r in found):
        return hits.drop("long")
    hits = stage(hits)
    low = F.lower(text)
    verified = df.select(key, text).join(hits.filter("long"), key).filter(
        F.contains(low, F.col("keyword")) & F.rlike(low, _pattern("keyword")))
    columns = (key, "pos", "keyword", "spelling")
    return hits.filter("not long").select(*columns).unionByName(verified.select(*columns))


def matches(df: DataFrame, keywords: Keywords, text: str, key: str,
            spelled: bool = False) -> DataFrame:
    """``(key, keyword)`` per keyword standing whole-word in the text, lower-cased
    or as ``spelled`` in the list."""
    listed = inline_keywords(df, keywords)
    if listed is None:
        found = matches_joined(df, keywords, text, key)
        return found.select(key, F.col("spelling" if spelled else "keyword").alias("keyword"))
    return explode_rows(df, [key], _inline_matches(text, listed, spelled), "keyword")


def with_matches(df: DataFrame, keywords: Keywords, text: str, out: str,
                 key: str = "response_id", spelled: bool = False) -> DataFrame:
    """Add the matching keywords of each row, in list order, as an array."""
    listed = inline_keywords(df, keywords)
    if listed is not None:
        return df.withColumn(out, _inline_matches(text, listed, spelled))
    found = matches_joined(df, keywords, text, key)
    name = F.col("spelling" if spelled else "keyword")
    packed = found.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", name.alias("name")))).alias("_m"))
    return df.join(packed, key, "left").withColumn(out, F.coalesce(
        F.transform("_m", lambda m: m["name"]), F.array().cast("array<string>"))).drop("_m")


def present_keywords(df: DataFrame, keywords: Keywords, text: str, key: str) -> DataFrame:
    """Keywords found in any text, lower-cased."""
    return matches(df, keywords, text, key).select("keyword").distinct()


def document_frequency(df: DataFrame, keywords: Keywords, text: str, key: str) -> DataFrame:
    """``(keyword, doc_freq, pos)``: texts holding each keyword (absent ones left
    out) and its place in the list.

    A text yields each keyword once, so a count with map-side combine is enough.
    """
    listed = inline_keywords(df, keywords)
    if listed is None:
        return matches_joined(df, keywords, text, key).groupBy(
            "keyword", "pos").agg(F.count("*").alias("doc_freq")).select("keyword", "doc_freq", "pos")
    counts = df.select(F.explode_outer(_inline_matches(text, listed, False)).alias("keyword")).filter(
        F.col("keyword").isNotNull()).groupBy("keyword").agg(F.count("*").alias("doc_freq"))
    places = small_table(df.sparkSession, [(k, i) for i, k in enumerate(listed)],
                         keyword=pa.string(), pos=pa.int64())
    return counts.join(places, "keyword")


