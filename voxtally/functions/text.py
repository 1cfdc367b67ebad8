"""Text cleaning and matching expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import distinct_sorted, let

SPACE = r"\p{Z}\t-\r\x{1C}-\x{1F}\x{85}"   # Unicode white space, inside [...]
WORD = r"\p{L}\p{N}_"                      # word characters, inside [...]
MATCH_WORD = WORD + r"\p{M}"                 # of keyword matching: marks belong to their letter
CLEAN_TOKEN = rf"[^\p{{P}}{SPACE}]+"
RUN = rf"[{MATCH_WORD}]+|[^{MATCH_WORD}]+"


def as_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    """Trim Unicode white space from both ends."""
    return F.regexp_replace(F.regexp_replace(c, rf"^[{SPACE}]+", ""), rf"[{SPACE}]+$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"[^{SPACE}]")


def space_tokens(c: Column) -> Column:
    """White-space separated tokens."""
    return F.regexp_extract_all(c, F.lit(rf"[^{SPACE}]+"), F.lit(0))


def clean_tokens(c: Column) -> Column:
    """Lower-cased tokens with punctuation treated as white space."""
    return F.regexp_extract_all(F.lower(as_text(c)), F.lit(CLEAN_TOKEN), F.lit(0))


def drop_words(tokens: Column, words: Sequence[str]) -> Column:
    """Remove the listed words, keeping order and repeats."""
    words = list(words)
    return F.filter(tokens, lambda x: ~x.isin(words)) if words else tokens


def lookup(word: Column, mapping: dict) -> Column:
    """Value of ``word`` in a dictionary of literals, NULL when absent.

    A map column is searched entry by entry, so words are tested against hash
    sets instead: one for all keys, then one per distinct value while those are
    few. Most words are in none and cost one probe.
    """
    keys = list(mapping)
    by_value: dict = {}
    for key, value in mapping.items():
        by_value.setdefault(value, []).append(key)
    if len(by_value) <= 100:
        found = F.lit(None)
        for value, members in by_value.items():
            found = F.when(word.isin(members), F.lit(value)).otherwise(found)
    else:
        found = F.try_element_at(
            F.create_map(*[F.lit(v) for pair in mapping.items() for v in pair]), word)
    return F.when(word.isin(keys), found)


def replace_words(tokens: Column, mapping: dict[str, str]) -> Column:
    """Map each token through a small dictionary; unknown tokens stay."""
    if not mapping:
        return tokens
    return F.transform(tokens, lambda x: F.coalesce(lookup(x, mapping), x))


def clean_text(c: Column, stop: Sequence[str] = (), lemmas: dict[str, str] | None = None) -> Column:
    """Lower-case, drop punctuation and stop words, lemmatise, join by space."""
    return F.array_join(replace_words(drop_words(clean_tokens(c), stop), lemmas or {}), " ")


def word_count(cleaned: Column) -> Column:
    """Tokens of a cleaned text; an empty text has none."""
    return F.size(space_tokens(as_text(cleaned)))


def substring_count(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of ``needle`` in ``text``, both as given."""
    removed = F.length(text) - F.length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, F.floor(removed / F.length(needle))).otherwise(0).cast("int")


def round_half_even(c: Column, digits: int = 2) -> Column:
    scale = float(10 ** digits)
    return F.rint(c * scale) / scale


# --- whole-word matching ----------------------------------------------------
#
# A keyword matches where it stands between word boundaries. Cut a text into
# its alternating runs of word and other characters: a keyword then matches
# exactly where its own runs equal consecutive runs of the text. A keyword with
# a non-word edge ("c++") needs a word character beyond that edge. Matching is
# therefore string equality on run n-grams, whose cost does not grow with the
# number of keywords and which is also an equi-join key.


def _is_word(ch: str) -> bool:
    return ch == "_" or unicodedata.category(ch)[0] in "LMN"


def split_runs(keyword: str) -> list[str]:
    """The alternating word / non-word runs of a (lower-cased) keyword."""
    return ["".join(run) for _, run in groupby(keyword, key=_is_word)]


def normalise_keywords(keywords: Sequence[str]) -> list[str]:
    """Trimmed, lower-cased, blank-free keywords; first sighting wins."""
    return list(dict.fromkeys(k for k in (k.strip().lower() for k in keywords) if k))


def text_runs(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(as_text(c)), F.lit(RUN), F.lit(0))


def matching_keywords(text: Column, keywords: Sequence[str]) -> Column:
    """Keywords standing whole-word in ``text``, in list order, each once."""
    listed = normalise_keywords(keywords)
    if not listed:
        return F.array().cast("array<string>")
    runs_of = {k: split_runs(k) for k in listed}
    heads = sorted({r[0] for r in runs_of.values()})
    sizes = sorted({len(r) for r in runs_of.values()})
    lead = [k for k in listed if not _is_word(k[0])]
    trail = [k for k in listed if not _is_word(k[-1])]

    def search(runs: Column) -> Column:
        def candidate(i: Column, size: int) -> Column:
            span = F.array_join(F.slice(runs, i, size), "") if size > 1 else F.get(runs, i - 1)

            def accept(x: Column) -> Column:
                ok = x.isin(listed)
                if lead:
                    ok = ok & ((i > 1) | ~x.isin(lead))
                if trail:
                    ok = ok & ((i + size - 1 < F.size(runs)) | ~x.isin(trail))
                return F.when(ok, x)

            return let(span, accept)

        def at(i: Column) -> Column:
            return F.array(*[candidate(i, size) for size in sizes])

        starts = F.filter(F.sequence(F.lit(1), F.size(runs)), lambda i: F.get(runs, i - 1).isin(heads))
        hits = F.array_distinct(F.array_compact(F.flatten(F.transform(starts, at))))
        order = F.array(*[F.lit(k) for k in listed])
        placed = F.sort_array(F.transform(
            hits, lambda h: F.struct(F.array_position(order, h).alias("pos"), h.alias("kw"))))
        return F.transform(placed, lambda s: s["kw"])

    empty = F.array().cast("array<string>")
    return let(text_runs(text), lambda runs: F.when(F.size(runs) > 0, search(runs)).otherwise(empty))


def run_ngrams(text: Column, sizes: Sequence[int], prefixes: dict[int, dict[str, bool]] | None = None) -> Column:
    """Distinct ``struct<span, lead, trail>`` of run n-grams of the given sizes.

    ``lead`` / ``trail`` tell whether a word character stands before / after,
    which a keyword with a non-word edge requires. ``prefixes`` names, for the
    sizes it holds, the beginnings of that many runs that wanted n-grams have,
    and whether one is a whole n-gram: a place is followed only while its runs
    begin a wanted n-gram, and of these sizes only whole ones are made.
    """
    listed = prefixes or {}
    empty = F.array().cast("array<struct<span:string,lead:boolean,trail:boolean>>")

    def spans(runs: Column) -> Column:
        def span(i: Column, size: int) -> Column:
            return F.array_join(F.slice(runs, i, size), "") if size > 1 else F.get(runs, i - 1)

        def wanted(begin: Column, size: int, names: list[str]) -> Column:
            return F.filter(begin, lambda i: span(i, size).isin(names)) if names else F.slice(begin, 1, 0)

        def made(begin: Column, size: int) -> Column:
            if size in listed:
                begin = wanted(begin, size, [p for p, whole in listed[size].items() if whole])
            return F.transform(begin, lambda i: F.struct(
                span(i, size).alias("span"), (i > 1).alias("lead"),
                (i + (size - 1) < F.size(runs)).alias("trail")))

        def grow(begin: Column, left: list[int], found: list[Column]) -> Column:
            if not left:
                return distinct_sorted(F.flatten(F.array(*found)))
            size, *rest = left
            begin = F.filter(begin, lambda i: i + (size - 1) <= F.size(runs))
            if size in listed:
                begin = wanted(begin, size, list(listed[size]))
            return let(begin, lambda b: grow(b, rest, [*found, made(b, size)] if size in sizes else found))

        return grow(F.sequence(F.lit(1), F.size(runs)), sorted({*sizes, *listed}), [])

    return let(text_runs(text), lambda runs: F.when(F.size(runs) > 0, spans(runs)).otherwise(empty))
