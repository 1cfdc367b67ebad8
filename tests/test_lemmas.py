"""Noun lemmas by rule against a plain transcription of the rules."""

import random

from voxtally.operators.lemmas import NOUN_RULES, noun_lemmas


def brute(word, index, exceptions):
    def known(forms):
        return [f for f in forms if f in index]

    if word in exceptions:
        found = known([word] + exceptions[word])
    else:
        forms = [word[: len(word) - len(a)] + b for a, b in NOUN_RULES if word.endswith(a)]
        found = known([word] + forms)
        while not found and forms:
            forms = [f[: len(f) - len(a)] + b for f in forms for a, b in NOUN_RULES if f.endswith(a)]
            found = known(forms)
    return min(found, key=len) if found else word


def run(spark, words, index, exceptions):
    w = spark.createDataFrame([(x,) for x in words], "word string")
    i = spark.createDataFrame([(x,) for x in index], "lemma string")
    e = spark.createDataFrame([(f, p, x) for f, xs in exceptions.items() for p, x in enumerate(xs)],
                              "form string, pos int, lemma string")
    return {r.word: r.lemma for r in noun_lemmas(w, i, e).collect()}


def test_common_cases(spark):
    index = {"glass", "box", "church", "wife", "city", "man", "bus", "mouse", "le", "la", "s", "wolf"}
    exceptions = {"mice": ["mouse"], "les": ["le", "la"], "oxen": ["ox"]}
    words = ["glasses", "boxes", "churches", "wives", "cities", "men", "mice", "les", "buses", "quizzes", "oxen",
             "glass", "s", "ss", "", "wolves", "womenses", None, "sheses"]
    got = run(spark, words, index, exceptions)
    assert got == {w: brute(w, index, exceptions) for w in words if w is not None}
    assert got["glasses"] == "glass" and got["wolves"] == "wolf" and got["wives"] == "wives" and got["oxen"] == "oxen" and got["les"] == "le"


def test_random_words(spark):
    rng = random.Random(5)
    pieces = ["s", "es", "ses", "ves", "x", "xes", "ch", "ches", "sh", "men", "man", "ies", "y", "a", "b", "f", "z"]
    words = {"".join(rng.choices(pieces, k=rng.randint(1, 6))) for _ in range(400)}
    index = {w for w in {"".join(rng.choices(pieces, k=rng.randint(1, 4))) for _ in range(300)}}
    exceptions = {w: [rng.choice(sorted(index)), rng.choice(sorted(words))] for w in rng.sample(sorted(words), 20)}
    assert run(spark, sorted(words), index, exceptions) == {w: brute(w, index, exceptions) for w in words}
