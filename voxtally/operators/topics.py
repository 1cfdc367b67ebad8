"""Topics from corpus TF-IDF and their assignment to responses."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import explode_rows
from ..functions.text import WORD, as_text, is_blank
from ..functions.wordlists import GENERIC_WORDS
from ..session import stage
from . import term_blocks
from .ids import dense_index
from .matching import Keywords, matches, with_matches
from .reshape import quoted

MIN_DOCS = 10
MAX_DOC_SHARE = 0.85
MAX_TEXT_SHARE = 0.30
MIN_TERM_CHARS = 5
TERMS_PER_TOPIC = 3
FIRST_TEST = 60        # candidates tested in the first pass over the texts
TEST_LIMIT = 960       # and at most in any later pass
BROADCAST_TERMS = 100_000   # terms up to which the optimizer may broadcast the vocabulary; beyond, it is hashed in shares
SCORED_TERMS = 50_000       # terms scored at first, about


TERMS = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())]))


def words(text: Column, stop: Sequence[str]) -> Column:
    """The words of terms: two characters or more, lower-cased, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(as_text(text)), F.lit(rf"[{WORD}]{{2,}}"), F.lit(0)),
                    lambda t: ~t.isin(list(stop)))


@F.arrow_udf(TERMS)
def term_counts(spaced: pa.Array) -> pa.Array:
    """One- and two-word terms of space-separated words, each once with its count."""
    ends, terms, counts = [0], [], []
    for text in spaced.to_pylist():
        if text:
            one = text.split(" ")
            found = Counter(one)
            found.update([f"{a} {b}" for a, b in zip(one, one[1:])])
            terms += found
            counts += found.values()
        ends.append(len(terms))
    pairs = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(counts, pa.int32())], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


def usable(df: DataFrame, text: str) -> DataFrame:
    """Rows with a non-blank text."""
    return df.filter(F.col(text).isNotNull() & ~is_blank(F.col(text)))


def postings(df: DataFrame, text: str, key: str, stop: Sequence[str]) -> DataFrame:
    """``(key, term, tf)``, each term of a document once.

    Counted inside the row, so repeats are never shuffled. Written once.
    """
    counted = term_counts(F.array_join(words(F.col(text), stop), " "))
    return stage(explode_rows(df, [key], counted, "_t").select(key, "_t.term", "_t.tf"))


def document_terms(blocks: DataFrame, buckets: int, n: int, min_docs: int = MIN_DOCS,
                   max_share: float = MAX_DOC_SHARE) -> DataFrame:
    """Document frequencies of the terms in enough but not too many of the n
    documents, as an answer to each block (``term_blocks``).

    Written once: it is used to prune and to weight.
    """
    return stage(term_blocks.document_frequencies(blocks, buckets, min_docs, max_share * n))


def answered(blocks: DataFrame, vocabulary: DataFrame, terms: int) -> DataFrame:
    """``blocks`` with ``found``, the answers of all buckets in order.

    They are broadcast while the vocabulary is small. Otherwise each task hashes
    its share of them; blocks, not postings, cross the exchange.
    """
    found = vocabulary.filter("block >= 0").groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("bucket", "dfs"))).alias("found"))
    if terms <= BROADCAST_TERMS:
        return blocks.join(found, "block")
    return blocks.repartition(F.col("block")).join(found.hint("shuffle_hash"), "block")


def key_norms(asked: DataFrame, buckets: int, n: int) -> DataFrame:
    """``asked`` with ``norms``: per document the squared norm over all documents of its key.

    Only needed when a key has several documents.
    """
    own = stage(term_blocks.weigh(asked, buckets, n, T.StructType([
        T.StructField("block", T.LongType()), T.StructField("at", T.LongType()),
        T.StructField("key", asked.schema["keys"].dataType.elementType), T.StructField("own", T.DoubleType())])))
    total = own.groupBy("key").agg(F.sum("own").alias("norm")).withColumnRenamed("key", "k")
    listed = own.join(total, F.col("key").eqNullSafe(F.col("k"))).groupBy("block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "norm"))), lambda x: x["norm"]).alias("norms"))
    return asked.join(listed, "block")


class Weighted:
    """Texts in blocks with the frequencies of their terms, ready to be weighted.

    ``n`` documents have a text. Made of two passes over the words: one counts,
    one (``weights``, ``scores``) weights.
    """

    def __init__(self, df: DataFrame, text: str, key: str, stop: Sequence[str], min_docs: int, max_share: float):
        self.blocks = stage(term_blocks.word_blocks(
            usable(df, text), key, F.array_join(words(F.col(text), stop), " ")))
        self.key, self.key_type = key, df.schema[key].dataType
        self.n = self.blocks.agg(F.sum(F.size("keys"))).first()[0] or 0
        if not self.enough(min_docs, max_share):
            return
        self.buckets = term_blocks.bucket_count(self.blocks)
        vocabulary = document_terms(self.blocks, self.buckets, self.n, min_docs, max_share)
        self.histogram = term_blocks.frequency_histogram(vocabulary)
        self.asked = answered(self.blocks, vocabulary, int(self.histogram.sum()))
        repeated = self.blocks.select(F.explode("keys").alias("key")).groupBy("key").count().filter("count > 1")
        if not repeated.isEmpty():
            self.asked = key_norms(self.asked, self.buckets, self.n)

    def enough(self, min_docs: int, max_share: float) -> bool:
        """Whether any term can be in enough and not too many documents."""
        return self.n > 0 and max_share * self.n >= min_docs

    def weights(self) -> DataFrame:
        """``(key, term, tf, weight)``: tf * idf scaled to length 1 per key."""
        raw = term_blocks.weigh(self.asked, self.buckets, self.n, T.StructType([
            T.StructField("key", self.key_type), T.StructField("term", T.StringType()),
            T.StructField("tf", T.IntegerType()), T.StructField("_w", T.DoubleType()),
            T.StructField("_norm", T.DoubleType())]))
        return raw.select(F.col("key").alias(self.key), "term", "tf", (F.col("_w") / F.sqrt("_norm")).alias("weight"))

    def scores(self, least: int) -> DataFrame:
        """``(term, df, score)``: the summed weight of each term in ``least`` documents or more.

        Weights are summed inside each block, only sums are moved.
        """
        sums = term_blocks.weigh(self.asked, self.buckets, self.n, T.StructType([
            T.StructField("term", T.StringType()), T.StructField("df", T.LongType()),
            T.StructField("score", T.DoubleType())]), least)
        return sums.groupBy("term").agg(F.max("df").alias("df"), F.round(F.sum("score"), 6).alias("score"))


def tfidf(df: DataFrame, text: str, key: str, stop: Sequence[str], min_docs: int = MIN_DOCS,
          max_share: float = MAX_DOC_SHARE) -> DataFrame:
    """TF-IDF weights of all documents as a long table."""
    weighted = Weighted(df, text, key, stop, min_docs, max_share)
    if not weighted.enough(min_docs, max_share):
        schema = T.StructType([df.schema[key], T.StructField("term", T.StringType()),
                               T.StructField("tf", T.IntegerType()), T.StructField("weight", T.DoubleType())])
        return df.sparkSession.createDataFrame([], schema)
    return weighted.weights()


def inferred_topics(df: DataFrame, text: str, key: str, stop: Sequence[str], num_topics: int = 5,
                    excluded: Sequence[str] = GENERIC_WORDS, min_docs: int = MIN_DOCS,
                    max_share: float = MAX_DOC_SHARE,
                    max_text_share: float = MAX_TEXT_SHARE) -> list[str]:
    """The best ``3 * num_topics`` terms by summed weight, at most that many names.

    A term must not occur as a substring in more than 30 % of the texts. Only
    the best candidates are tested, a bounded number in each pass over the
    texts, until enough pass, so the result is the same as testing all.

    Only terms in ``least`` documents or more are scored at first. No weight is
    above 1, so every other term scores less than ``least``; when a candidate
    that is wanted may be among them, ``least`` is lowered and all is scored anew.
    """
    wanted = num_topics * TERMS_PER_TOPIC
    weighted = Weighted(df, text, key, stop, min_docs, max_share)
    n = weighted.n
    if n < 2 or not weighted.enough(min_docs, max_share):
        return []
    limit = max_text_share * n
    blocked = [w for w in {*stop, *excluded} if len(w) >= MIN_TERM_CHARS]

    def best_of(least: int) -> DataFrame:
        scored = stage(
            weighted.scores(least)
            .filter((F.length("term") >= MIN_TERM_CHARS) & ~F.col("term").isin(blocked)
                    & ~F.replace("term", F.lit(" "), F.lit("")).rlike(r"^\p{Nd}+$"))
            # a single word is a substring wherever it is a token: prune before testing
            .filter(F.contains("term", F.lit(" ")) | (F.col("df") <= limit)))
        return scored.orderBy(F.desc("score"), "term").select("term", "score")

    valid = usable(df, text)
    terms = SCORED_TERMS
    least = term_blocks.frequency_of_the_first(weighted.histogram, terms)
    best = best_of(least)

    chosen: list[str] = []
    tested, batch = 0, max(FIRST_TEST, 4 * wanted)
    while len(chosen) < wanted:
        rows = best.offset(tested).limit(batch).collect()
        if least > min_docs and (len(rows) < batch or rows[-1]["score"] < least):
            if len(rows) == batch:
                least = int(rows[-1]["score"])
            else:
                terms *= 32
                least = min(least - 1, term_blocks.frequency_of_the_first(weighted.histogram, terms))
            best, chosen, tested, batch = best_of(least), [], 0, max(FIRST_TEST, 4 * wanted)
            continue
        found = [r["term"] for r in rows]
        if found:
            chosen += _not_too_common(valid, text, found, limit)
        if len(found) < batch:
            break
        # passes grow to TEST_LIMIT candidates, which bounds what is collected and inlined
        tested, batch = tested + batch, min(2 * batch, max(batch, TEST_LIMIT))
    return chosen[:wanted]


def _not_too_common(df: DataFrame, text: str, candidates: list[str], limit: float) -> list[str]:
    lowered = df.select(F.lower(F.col(text)).alias("_t"))
    row = lowered.agg(*[F.count_if(F.contains("_t", F.lit(c))).alias(f"c{i}")
                        for i, c in enumerate(candidates)]).first()
    return [c for c, n in zip(candidates, row) if n <= limit]


def topic_universe(provided: Sequence[str], inferred: Sequence[str]) -> list[tuple[int, str, str]]:
    """``(pos, topic, origin)``: provided topics, then inferred ones not yet there,
    compared without case."""
    out, seen = [], set()
    for origin, names in (("provided", provided), ("inferred", inferred)):
        for name in names:
            if name.lower() not in seen:
                seen.add(name.lower())
                out.append((len(out) + 1, name, origin))
    return out


def topic_universe_table(provided: DataFrame, inferred: DataFrame) -> DataFrame:
    """The same for tables ``(pos, topic)`` of any size; ``pos`` keeps the order."""
    both = provided.select(F.lit(0).alias("_o"), "pos", "topic").unionByName(
        inferred.select(F.lit(1).alias("_o"), "pos", "topic"))
    first = F.min(F.struct("_o", "pos", "topic")).alias("f")
    kept = both.groupBy(F.lower("topic").alias("_k")).agg(first).select(
        F.struct("f._o", "f.pos").alias("_order"), F.col("f.topic").alias("topic"),
        F.when(F.col("f._o") == 0, "provided").otherwise("inferred").alias("origin"))
    return dense_index(kept, "_order", out="pos").select("pos", "topic", "origin")


def assign_topics(df: DataFrame, topics: Keywords, text: str, key: str) -> DataFrame:
    """``(key, topic)`` per topic standing whole-word in the text."""
    return matches(df, topics, text, key, spelled=True).withColumnRenamed("keyword", "topic")


def with_topics(df: DataFrame, topics: Keywords, text: str, key: str = "response_id",
                out: str = "topics") -> DataFrame:
    """Add the matching topics of each row, in list order, as an array."""
    return with_matches(df, topics, text, out, key, spelled=True)


def topic_counts(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("topic").agg(F.count("*").alias("responses"))


def topic_rows(assigned: DataFrame, key: str) -> DataFrame:
    """``(topic, row_no, key)``: the topic table as long rows, for any number of topics.

    Rows are numbered within a topic by a range sort, so a topic that holds most
    responses is still spread over tasks.
    """
    return dense_index(assigned.select("topic", key), key, out="row_no", within="topic")


def topic_matrix(assigned: DataFrame, topics: Sequence[str], key: str) -> DataFrame:
    """One column per matched topic, response ids packed from the top, "" below."""
    ranked = topic_rows(assigned, key)
    present = {r["topic"] for r in ranked.select("topic").distinct().collect()}
    names = [t for t in topics if t in present]
    if not names:
        return ranked.select("row_no").limit(0)
    cells = ranked.groupBy("row_no").pivot("topic", names).agg(F.max(key))
    return cells.select("row_no", *[
        F.coalesce(quoted(t).cast("string"), F.lit("")).alias(t) for t in names])
