"""Sentiment scores and labels."""

from __future__ import annotations

import string
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wordlists as L
from ..functions.arrays import let
from ..functions.text import as_text, lookup, space_tokens
from ..session import bounded_rows
from .cleaning import one_value, with_entries


def label_of(score: Column) -> Column:
    """Positive from 0.05, negative to -0.05, else neutral."""
    return F.when(score >= L.SENTIMENT_CUTOFF, "positive").when(
        score <= -L.SENTIMENT_CUTOFF, "negative").otherwise("neutral")


def wordset_score(text: Column, positive: Sequence[str] = L.POSITIVE_WORDS,
                  negative: Sequence[str] = L.NEGATIVE_WORDS) -> Column:
    """+0.5, -0.5 or 0.0 by the numbers of distinct listed words in the text."""
    def compare(words: Column) -> Column:
        pos = F.size(F.filter(words, lambda w: w.isin(list(positive))))
        neg = F.size(F.filter(words, lambda w: w.isin(list(negative))))
        return F.when(pos > neg, 0.5).when(neg > pos, -0.5).otherwise(0.0)

    return let(F.array_distinct(space_tokens(F.lower(as_text(text)))), compare)


def add_wordset_sentiment(df: DataFrame, text: str = "response_text_original",
                          positive: Sequence[str] = L.POSITIVE_WORDS,
                          negative: Sequence[str] = L.NEGATIVE_WORDS) -> DataFrame:
    """Add score and label by word sets. Map-only."""
    return df.withColumn("sentiment_score", wordset_score(F.col(text), positive, negative)).withColumn(
        "sentiment_label", label_of(F.col("sentiment_score")))


# --- lexicon and rules ------------------------------------------------------


def lexicon_tokens(text: Column) -> Column:
    """White-space tokens without outer ASCII punctuation, unless that leaves
    two characters or fewer (which keeps emoticons)."""
    return F.transform(space_tokens(as_text(text)), lambda t: let(
        F.btrim(t, F.lit(string.punctuation)), lambda b: F.when(F.length(b) > 2, b).otherwise(t)))


def _is_upper(w: Column) -> Column:
    return (F.lower(w) != w) & (F.upper(w) == w)   # most words end at the first test


def _emphasis(text: Column) -> Column:
    bangs = F.least(F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))), F.lit(4))
    marks = F.length(text) - F.length(F.replace(text, F.lit("?"), F.lit("")))
    return bangs * 0.292 + F.when(marks <= 1, 0.0).when(marks <= 3, marks * 0.18).otherwise(0.96)


def _valence(x: Column, boosters: Sequence[str], dampeners: Sequence[str],
             negations: Sequence[str], idioms: dict[str, float]) -> Column:
    """Valence of one lexicon word after the look-back rules.

    ``x`` is the word's context: ``w0..w3`` the word and the three before it, ``l0..l3``
    the same in lower case, ``n1, n2`` the next two, ``k1..k3, kn`` whether those
    are in the lexicon, ``lex`` the word's own valence, ``cap`` whether only part
    of the text is in capitals.
    """
    def is_(field: str, *values: str) -> Column:
        return F.coalesce(x[field].isin(list(values)), F.lit(False))

    def flip(field: str) -> Column:
        negated = x[field].isin(list(negations)) | F.contains(x[field], F.lit("n't"))
        return F.when(negated, L.NEGATION_SCALE).otherwise(1.0)

    def push(word: Column) -> Column:
        return F.when(word.isin(list(boosters)), L.BOOST).when(
            word.isin(list(dampeners)), L.DAMPEN).otherwise(0.0)

    def signed(v: Column, amount: Column) -> Column:
        return F.when(v > 0, amount).otherwise(-amount)

    def look_back(v: Column, back: int, scale: float, factor: Column) -> Column:
        degree = push(x[f"l{back}"])
        loud = F.when((degree != 0) & _is_upper(x[f"w{back}"]) & x["cap"],
                      signed(v, F.lit(L.CAPS_BOOST))).otherwise(0.0)
        moved = v + (degree * F.when(v < 0, -1.0).otherwise(1.0) + loud) * scale
        seen = x[f"l{back}"].isNotNull() & ~x[f"k{back}"]
        return F.when(seen, moved * factor).otherwise(v)

    def grams(*fields: str) -> Column:
        return F.concat_ws(" ", *[x[f] for f in fields])

    def set_phrases(v: Column) -> Column:
        """Idioms replace the valence; two-word degree adverbs before it add to it."""
        looked_up = [grams("l0", "n1", "n2"), grams("l0", "n1"), grams("l1", "l0"),
                     grams("l2", "l1", "l0"), grams("l2", "l1"), grams("l3", "l2", "l1"),
                     grams("l3", "l2")] if idioms else []
        value = F.coalesce(*[lookup(g, idioms) for g in looked_up], v)
        for g in (grams("l3", "l2", "l1"), grams("l3", "l2"), grams("l2", "l1")):
            value = value + push(g)
        return F.when(x["l3"].isNotNull() & ~x["k3"], value).otherwise(v)

    two = F.when(is_("l2", "never") & is_("l1", "so", "this"), 1.25).when(
        is_("l2", "without") & is_("l1", "doubt"), 1.0).otherwise(flip("l2"))
    three = F.when(is_("l3", "never") & (is_("l2", "so", "this") | is_("l1", "so", "this")), 1.25).when(
        is_("l3", "without") & (is_("l2", "doubt") | is_("l1", "doubt")), 1.0).otherwise(flip("l3"))
    after_no = is_("l1", "no") | is_("l2", "no") | (is_("l3", "no") & is_("l1", "or", "nor"))
    own = F.when(after_no, x["lex"] * L.NEGATION_SCALE).when(
        is_("l0", "no") & x["kn"], 0.0).otherwise(x["lex"])
    capitals = F.when(_is_upper(x["w0"]) & x["cap"], L.CAPS_BOOST).otherwise(0.0)
    least = is_("l1", "least") & ~x["k1"] & ~is_("l2", "at", "very")

    v = let(own, lambda v: v + signed(v, capitals))
    v = let(v, lambda v: look_back(v, 1, 1.0, flip("l1")))
    v = let(v, lambda v: look_back(v, 2, 0.95, two))
    v = let(v, lambda v: look_back(v, 3, 0.9, three))
    v = let(v, set_phrases)
    return F.when(least, v * L.NEGATION_SCALE).otherwise(v)


def compound_score(text: Column, valence: Callable[[Column], Column],
                   boosters: Sequence[str] = L.BOOSTERS, dampeners: Sequence[str] = L.DAMPENERS,
                   negations: Sequence[str] = L.NEGATIONS,
                   idioms: dict[str, float] | None = None) -> Column:
    """Score in [-1, 1], 4 digits; ``valence`` gives a lower-cased word's valence or NULL.

    All inside the row: each word is looked up once, and only the hits go
    through the rules.
    """
    idioms = L.IDIOMS if idioms is None else idioms
    degree = [b for b in [*boosters, *dampeners] if " " not in b]

    def score(s: Column) -> Column:
        words, low, vals = s["words"], s["low"], s["vals"]
        upper = F.size(F.filter(words, lambda w, i: (F.get(low, i) != w) & (F.upper(w) == w)))
        but = F.array_position(low, "but")

        def counts(i: Column) -> Column:
            here = F.get(low, i - 1)
            return (F.get(vals, i - 1).isNotNull() & ~here.isin(degree)
                    & ~((here == "kind") & F.get(low, i).eqNullSafe("of")))

        def hit(i: Column, doc: Column) -> Column:
            context = F.struct(
                *[F.get(words, i - 1 - b).alias(f"w{b}") for b in range(4)],
                *[F.get(low, i - 1 - b).alias(f"l{b}") for b in range(4)],
                *[F.get(low, i - 1 + b).alias(f"n{b}") for b in (1, 2)],
                *[F.get(vals, i - 1 - b).isNotNull().alias(f"k{b}") for b in (1, 2, 3)],
                F.get(vals, i).isNotNull().alias("kn"), F.get(vals, i - 1).alias("lex"),
                doc["cap"].alias("cap"))
            contrast = F.when(doc["but"] == 0, 1.0).when(i < doc["but"], 0.5).when(
                i > doc["but"], 1.5).otherwise(1.0)
            v = let(context, lambda x: _valence(x, boosters, dampeners, negations, idioms))
            return F.round(v * contrast, 9)

        def total(hits: Column) -> Column:
            doc = F.struct(((upper > 0) & (upper < F.size(words))).alias("cap"), but.alias("but"))
            return F.when(F.size(hits) > 0, let(doc, lambda d: F.aggregate(
                hits, F.lit(0.0), lambda acc, i: acc + hit(i, d)))).otherwise(0.0)

        hits = F.when(F.size(words) > 0, F.filter(F.sequence(F.lit(1), F.size(words)), counts)
                      ).otherwise(F.array().cast("array<int>"))
        return let(hits, total)

    prepared = let(lexicon_tokens(text), lambda ws: let(
        F.transform(ws, F.lower),
        lambda low: F.struct(ws.alias("words"), low.alias("low"),
                             F.transform(low, valence).alias("vals"))))
    emphasis = _emphasis(as_text(text))
    lifted = let(let(prepared, score), lambda t: F.when(t > 0, t + emphasis).when(
        t < 0, t - emphasis).otherwise(t))
    scaled = let(lifted, lambda t: t / F.sqrt(t * t + L.NORMALISER))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round(scaled, 4)))


def add_lexicon_sentiment(df: DataFrame, lexicon: DataFrame | dict[str, float], text: str = "response_text_original",
                          key: str = "response_id", **rules) -> DataFrame:
    """Add the rule-based compound score and label from a ``(term, valence)`` table
    or a dictionary.

    A lexicon of up to ``INLINE_LIMIT`` terms is inlined and nothing is
    shuffled; a larger one is joined to the distinct words of each text.
    """
    known = lexicon
    if isinstance(lexicon, DataFrame):
        table = one_value(lexicon.withColumn("valence", F.col("valence").cast("double")), "term", "valence")
        rows = bounded_rows(table)
        known = None if rows is None else {r["word"]: r["value"] for r in rows}
    if known is not None:
        score = compound_score(F.col(text), lambda w: lookup(w, known).cast("double"), **rules)
        df = df.withColumn("sentiment_score", score)
    else:
        words = F.transform(lexicon_tokens(F.col(text)), F.lower)
        joined = with_entries(df, words, table, key, "_lex")
        score = compound_score(F.col(text), lambda w: F.try_element_at("_lex", w), **rules)
        df = joined.withColumn("sentiment_score", score).drop("_lex")
    return df.withColumn("sentiment_label", label_of(F.col("sentiment_score")))
