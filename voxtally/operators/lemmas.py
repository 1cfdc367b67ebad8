"""Noun lemmas by rule: exceptions, suffix detachment and an index of known lemmas, over distinct words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage

# WordNet's detachment rules for nouns, (suffix, replacement), in this order.
NOUN_RULES = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"),
              ("men", "man"), ("ies", "y"))


def noun_lemmas(words: DataFrame, index: DataFrame, exceptions: DataFrame, word: str = "word") -> DataFrame:
    """``word, lemma`` for every distinct non-NULL word of ``words``.

    ``index`` (``lemma``) lists known noun lemmas; ``exceptions`` (``form, pos,
    lemma``) irregular forms, ``pos`` ordering the lemmas of one form. A word
    with exceptions has the candidates itself, then its exception lemmas; any
    other word itself and its forms after one rule of ``NOUN_RULES``, and if
    none of those is known, the forms after two rules, three, ... until some
    are known or none are left. Of the known candidates of the first round
    that has any, the shortest wins, ties to the earlier candidate (the word,
    then by rule order of each step); without any the word is its own lemma.

    Work is over distinct words, a table that grows with the vocabulary, not
    with the text; each round is a join with the index, and words leave as
    soon as they are decided. Forms reached twice in a round are kept once,
    by their earliest path, which decides nothing else.
    """
    distinct = stage(words.select(F.col(word).alias("word")).filter(F.col("word").isNotNull()).distinct())
    known = index.select(F.col("lemma").alias("form")).filter(F.col("form").isNotNull()).distinct()
    exc = exceptions.select(F.col("form").alias("word"), "pos", F.col("lemma").alias("form"))
    irregular = distinct.join(exc.select("word").distinct(), "word", "left_semi")
    candidates = irregular.select("word", F.array(F.lit(-1)).alias("path"), F.col("word").alias("form")).unionByName(
        irregular.join(exc, "word").select("word", F.array(F.col("pos")).alias("path"), "form"))
    decided = [_best(candidates.join(known, "form", "left_semi"))]
    regular = distinct.join(irregular, "word", "left_anti")
    forms = stage(_step(regular.select("word", F.array().cast("array<int>").alias("path"), F.col("word").alias("form"))))
    level = regular.select("word", F.array(F.lit(-1)).alias("path"), F.col("word").alias("form")).unionByName(forms)
    while True:
        found = stage(_best(level.join(known, "form", "left_semi")))
        decided.append(found)
        forms = forms.join(found.select("word"), "word", "left_anti")
        if forms.isEmpty():
            break
        forms = stage(_step(forms))
        level = forms
    lemmas = decided[0]
    for more in decided[1:]:
        lemmas = lemmas.unionByName(more)
    return distinct.join(lemmas, "word", "left").select("word", F.coalesce("lemma", "word").alias("lemma"))


def _step(forms: DataFrame) -> DataFrame:
    """Every form after one more rule, with its path; a form reached twice keeps its earliest path."""
    tried = F.array(*[F.when(F.col("form").endswith(old), F.struct(
        F.lit(i).alias("rule"),
        F.concat(F.expr(f"substring(form, 1, length(form) - {len(old)})"), F.lit(new)).alias("next")))
        for i, (old, new) in enumerate(NOUN_RULES)])
    stepped = forms.select("word", "path", F.explode(F.filter(tried, lambda s: s.isNotNull())).alias("s"))
    nexts = stepped.select("word", F.concat("path", F.array("s.rule")).alias("path"), F.col("s.next").alias("form"))
    return nexts.groupBy("word", "form").agg(F.min("path").alias("path"))


def _best(known: DataFrame) -> DataFrame:
    """The shortest known form of each word, ties to the earliest path."""
    key = F.struct(F.length("form").alias("n"), F.col("path").alias("p"), F.col("form").alias("f"))
    return known.groupBy("word").agg(F.min(key)["f"].alias("lemma"))
