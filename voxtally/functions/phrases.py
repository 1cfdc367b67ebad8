"""Ranked key phrases (RAKE; Rose et al., 2010) inside one row.

Texts are cut by column expressions; phrases are scored and ranked in Arrow
batches, with a dictionary of words per text. Everything is linear in the text
but for the sort of its phrases, and nothing is shuffled: a group of equal
texts or one hot source costs no more than the same number of different texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import let, tally
from .text import (SPACE, WORD, as_text, clean_tokens, drop_words, replace_words, strip,
                   substring_count)

PHRASES = T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("phrase", T.StringType())]))
KEYWORDS = T.ArrayType(T.StructType([T.StructField("keyword", T.StringType()), T.StructField("count", T.IntegerType())]))
_DIGITS = Decimal("0.000001")
BAG = "array<struct<keyword:string,count:int>>"


def marked_phrases(text: Column, stop: Sequence[str]) -> Column:
    """The lower-cased words in order, with "|" for each stop word, punctuation run and line end."""
    marked = F.regexp_replace(F.lower(as_text(text)), rf"[^{WORD}{SPACE}]+|[\r\n]+", " | ")
    tokens = F.split(marked, rf"[{SPACE}]+")
    return F.array_join(F.transform(tokens, lambda t: F.when(t.isin(list(stop)), F.lit("|")).otherwise(t)), " ")


def candidate_phrases(text: Column, stop: Sequence[str]) -> Column:
    """Maximal runs of word tokens between stop words, punctuation and line ends."""
    pieces = F.split(marked_phrases(text, stop), r"\|")
    return F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: p != "")


def _scores(phrases: list[list[str]]) -> list[float]:
    """Score per candidate: sum over its words of degree / frequency.

    The degree of a word is the summed length of the phrases it occurs in, per
    occurrence. Ratios are added from the smallest on.
    """
    degree: dict[str, float] = {}
    frequency: dict[str, int] = {}
    for words in phrases:
        n = len(words)
        for w in words:
            degree[w] = degree.get(w, 0.0) + n
            frequency[w] = frequency.get(w, 0) + 1
    ratio = {w: d / frequency[w] for w, d in degree.items()}
    out = []
    for words in phrases:
        score = 0.0      # not sum(), which corrects its rounding errors
        for r in sorted([ratio[w] for w in words]) if len(words) > 2 else [ratio[w] for w in words]:
            score += r
        out.append(score)
    return out


def _round(score: float) -> float:
    """Half-up on the decimal digits, as Spark rounds."""
    return score if score == int(score) else float(Decimal(repr(score)).quantize(_DIGITS, ROUND_HALF_UP))


def _ranked(marked: str) -> tuple[list[float], list[str]]:
    """Scores (rounded) and phrases of a marked text: score descending, then phrase descending."""
    found = [p for p in [piece.strip(" ") for piece in marked.split("|")] if p]
    best = sorted(zip(map(_round, _scores([p.split(" ") for p in found])), found), reverse=True)
    return [s for s, _ in best], [p for _, p in best]


def _lists(ends: list[int], **fields: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
        list(fields.values()), list(fields)))


@F.arrow_udf(PHRASES)
def rank_marked(marked: pa.Array) -> pa.Array:
    """The ranked candidates of marked texts, repeats kept."""
    ends, scores, phrases = [0], [], []
    for text in marked.to_pylist():
        s, p = _ranked(text or "")
        scores += s
        phrases += p
        ends.append(len(phrases))
    return _lists(ends, score=pa.array(scores, pa.float64()), phrase=pa.array(phrases, pa.string()))


def ranked_phrases(text: Column, stop: Sequence[str], distinct: bool = True) -> Column:
    """``array<struct<score, phrase>>``: score descending, then phrase descending.

    Scores are rounded to 6 digits so that ranks do not depend on the order of addition.
    """
    best_first = rank_marked(marked_phrases(text, stop))
    if not distinct:
        return best_first
    return let(best_first, lambda arr: F.filter(
        arr, lambda x, i: (i == 0) | (x["phrase"] != F.get(arr, i - 1)["phrase"])))


def _bag_maker(excluded: frozenset[str], k: int):
    @F.arrow_udf(KEYWORDS)
    def bags(clean: pa.Array, marked: pa.Array) -> pa.Array:
        """Keyword bags of texts, from the text and its marked form."""
        ends, keywords, counts = [0], [], []
        for text, candidates in zip(clean.to_pylist(), marked.to_pylist()):
            # equal phrases have equal scores: neighbours, one of them is kept
            best = dict.fromkeys(_ranked(candidates)[1])
            picked = list(islice((p for p in best if p not in excluded and p in text), k))
            keywords += picked
            counts += [text.count(p) for p in picked]
            ends.append(len(keywords))
        return _lists(ends, keyword=pa.array(keywords, pa.string()), count=pa.array(counts, pa.int32()))

    return bags


def top_phrases(text: Column, stop: Sequence[str], excluded: Sequence[str], k: int = 5) -> Column:
    """Keyword bag of the k best phrases that are not excluded and occur literally.

    The value is the literal, non-overlapping count of the phrase in the text.
    Texts shorter than three characters give an empty bag.
    """
    clean = F.lower(strip(as_text(text)))
    long_enough = F.when(F.length(clean) >= 3, clean).otherwise("")
    return _bag_maker(frozenset(excluded), k)(clean, marked_phrases(long_enough, stop))


def top_phrases_simple(text: Column, stop: Sequence[str], k: int = 5) -> Column:
    """The first k ranked phrases of at least three characters, repeats kept."""
    ranked = F.filter(ranked_phrases(text, stop, distinct=False),
                      lambda p: F.length(p["phrase"]) >= 3)
    return F.transform(F.slice(ranked, 1, k), lambda p: p["phrase"])


def frequent_tokens(text: Column, stop: Sequence[str], excluded: Sequence[str],
                    k: int = 5, lemmas: dict[str, str] | None = None) -> Column:
    """Keyword bag of the k most frequent cleaned tokens, ties by first occurrence."""
    excluded = list(excluded)
    tokens = F.filter(replace_words(drop_words(clean_tokens(text), stop), lemmas or {}),
                      lambda t: (F.length(t) > 2) & ~t.isin(excluded))
    ranked = F.sort_array(F.transform(tally(tokens), lambda x: F.struct(
        (-x["n"]).alias("n"), x["first"].alias("first"), x["item"].alias("item"))))
    return F.transform(F.slice(ranked, 1, k), lambda x: F.struct(
        x["item"].alias("keyword"), (-x["n"]).alias("count")))


def boost(bag: Column, keywords: Column) -> Column:
    """Add one to each keyword already in the bag and append the others with 1."""
    def merge(b: Column, keywords: Column) -> Column:
        raised = F.transform(b, lambda x: F.struct(
            x["keyword"].alias("keyword"),
            (x["count"] + F.when(F.array_contains(keywords, x["keyword"]), 1).otherwise(0))
            .cast("int").alias("count")))
        held = F.transform(b, lambda x: x["keyword"])
        fresh = F.transform(F.array_except(keywords, held), lambda kw: F.struct(
            kw.alias("keyword"), F.lit(1).alias("count")))
        return F.concat(raised, fresh)

    # both evaluated once a row, not once an entry
    return let(F.struct(bag.alias("bag"), keywords.alias("found")), lambda s: merge(s["bag"], s["found"]))


def bag_keys(bag: Column) -> Column:
    """Keys in order as a comma list; an empty bag gives an empty text."""
    return F.coalesce(F.array_join(F.transform(bag, lambda x: x["keyword"]), ", "), F.lit(""))


def bag_to_json(bag: Column) -> Column:
    return F.to_json(bag)


def bag_from_json(text: Column) -> Column:
    """Decode a bag; undecodable text gives NULL."""
    return F.from_json(text, BAG)
