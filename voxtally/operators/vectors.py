"""Vector columns and their similarity to a vocabulary.

Vectors come as ``array<float>`` columns: precomputed, from word vectors
(``mean_vectors``) or from an encoder run over Arrow batches (``embed``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import explode_rows, tally
from ..functions.text import as_text, space_tokens
from ..functions.wordlists import SIMILARITY_THRESHOLD
from ..session import bounded_rows, stage
from .ids import dense_index

# Size up to which a vocabulary is broadcast as one matrix: 64 MB. A larger one
# is broadcast in blocks of that size, one after the other.
MATRIX_CELLS = 8_000_000
MATRIX_ROWS = 20_000


def normalise(vec: Column) -> Column:
    """Vector divided by its length plus 1e-10."""
    doubles = vec.cast("array<double>")
    norm = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.zip_with(doubles, F.array_repeat(norm, F.size(vec)), lambda x, n: x / (n + F.lit(1e-10)))


def embed(df: DataFrame, text: str, out: str,
          load: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """Encode texts in Arrow batches; ``load`` builds the encoder once per worker task."""
    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for texts in batches:
            vecs = np.asarray(encoder(texts.fillna("").tolist()), dtype=float)
            vecs = vecs / (np.linalg.norm(vecs, axis=1, keepdims=True) + 1e-10)
            yield pd.Series(list(vecs))

    return df.withColumn(out, encode(F.col(text)))


def vector_size(df: DataFrame, vec: str) -> int:
    """The common length of a vector column, 0 without vectors; differing lengths are an error."""
    size = F.size(F.col(vec))
    least, most = df.filter(F.col(vec).isNotNull()).agg(F.min(size), F.max(size)).first()
    if least != most:
        raise ValueError(f"{vec} holds vectors of {least} to {most} numbers")
    return least or 0


def mean_by(df: DataFrame, key: str, vec: str, dim: int, out: str, weight: str | None = None) -> DataFrame:
    """Mean vector per key: one average per dimension, combined map-side, so a
    key with very many vectors moves one row per task. ``weight`` names a count."""
    items = F.col(vec)
    w = F.lit(1) if weight is None else F.col(weight)
    total = F.sum(F.when(items.isNotNull(), w))
    means = df.groupBy(key).agg(total.alias("_n"), *[
        F.sum(items[i].cast("double") * w).alias(f"_d{i}") for i in range(dim)])
    return means.select(key, F.array(*[F.col(f"_d{i}") / F.col("_n") for i in range(dim)]).alias(out))


def mean_vectors(df: DataFrame, text: str, key: str, word_vectors: DataFrame,
                 out: str = "vec", missing_as_zero: bool = False) -> DataFrame:
    """``(key, vec)``: normalised mean of the word vectors of each text.

    The vectors' own length is kept whole. A word is joined once per text, with
    its count. Words without a vector are skipped; a text without any gives
    NULL, or a zero vector for batch use.
    """
    dim = vector_size(word_vectors, "vec")
    counted = F.transform(tally(space_tokens(F.lower(as_text(F.col(text))))),
                          lambda t: F.struct(t["item"].alias("word"), t["n"].alias("n")))
    words = explode_rows(df, [key], counted, "_w").select(key, "_w.word", "_w.n")
    means = mean_by(words.join(word_vectors.select("word", "vec"), "word"), key, "vec", dim, "_mean", "n")
    vec = normalise(F.col("_mean"))
    if missing_as_zero:
        vec = F.coalesce(vec, F.array_repeat(F.lit(0.0), dim))
    return df.select(key).join(means, key, "left").select(key, vec.alias(out))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(arr.flatten(), dtype=np.float64).reshape(len(arr), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-10)


def best_match(df: DataFrame, key: str, vec: str, vocabulary: DataFrame) -> DataFrame:
    """``(key, similarity, closest)``: the vocabulary keyword of largest cosine.

    ``vocabulary`` has ``pos, keyword, vec``; the lowest ``pos`` wins ties. A
    vocabulary of up to 64 MB is broadcast as one matrix and every Arrow batch is
    one product, with no shuffle. A larger one is cut into blocks of that size.
    Vectors that are NULL give similarity 0 and an empty keyword.
    """
    vectors = df.select(key, F.col(vec).alias("vec"))
    rows = bounded_rows(vocabulary.select("pos", "keyword", "vec"), MATRIX_ROWS)
    if rows is None or len(rows) * len(rows[0]["vec"] if rows else ()) > MATRIX_CELLS:
        # written once: an encoder's output must not be computed twice
        return _best_blocked(stage(vectors), key, stage(vocabulary.select("pos", "keyword", "vec")))
    if not rows:
        return df.select(key, F.lit(0.0).alias("similarity"), F.lit("").alias("closest"))
    return _best_broadcast(vectors, key, rows)


def _scorer(df: DataFrame, key: str, rows: list) -> DataFrame:
    """``(key, similarity, pos, closest)`` by one broadcast matrix; pos is -1 for a NULL vector."""
    rows = sorted(rows, key=lambda r: r["pos"])
    matrix = _unit(np.array([r["vec"] for r in rows], dtype=np.float64))
    shared = df.sparkSession.sparkContext.broadcast(
        (matrix, [r["keyword"] for r in rows], [r["pos"] for r in rows]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, names, places = shared.value
        for batch in batches:
            vecs = batch.column("vec")
            filled = np.asarray(vecs.is_valid())
            similarity, closest = np.zeros(len(vecs)), np.full(len(vecs), -1)
            if filled.any():
                sims = _unit(_matrix(vecs.drop_null())) @ vocab.T
                closest[filled] = np.round(sims, 12).argmax(axis=1)
                similarity[filled] = sims.max(axis=1)
            yield pa.RecordBatch.from_arrays([
                batch.column(key), pa.array(similarity),
                pa.array([places[i] if i >= 0 else -1 for i in closest], pa.int64()),
                pa.array([names[i] if i >= 0 else "" for i in closest], pa.string())],
                names=[key, "similarity", "pos", "closest"])

    return df.mapInArrow(score, f"{key} {dict(df.dtypes)[key]}, similarity double, pos long, closest string")


def _best_broadcast(df: DataFrame, key: str, rows: list) -> DataFrame:
    return _scorer(df, key, rows).drop("pos")


def _best_blocked(df: DataFrame, key: str, vocabulary: DataFrame) -> DataFrame:
    """Every vocabulary block is broadcast in turn; the vectors stay where they are.

    Each block gives one small row per vector, and the best over the blocks is
    an aggregate with map-side combine, so no vector is ever shuffled.
    """
    per_block = max(1, min(MATRIX_ROWS, MATRIX_CELLS // max(1, vector_size(vocabulary, "vec"))))
    numbered = stage(dense_index(vocabulary, "pos", out="_rank").withColumn(
        "_block", F.floor((F.col("_rank") - 1) / per_block)))
    blocks = numbered.agg(F.max("_block")).first()[0] + 1
    scored = [_scorer(df, key, numbered.filter(F.col("_block") == b).select("pos", "keyword", "vec").collect())
              for b in range(blocks)]
    best = F.max_by(F.struct("similarity", "closest"), F.struct(F.round("similarity", 12), -F.col("pos")))
    return reduce(DataFrame.union, scored).groupBy(key).agg(best.alias("_b")).select(
        key, F.col("_b.similarity").alias("similarity"), F.col("_b.closest").alias("closest"))


def similar_to(df: DataFrame, key: str, vec: str, vocabulary: DataFrame,
               threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """Rows whose largest cosine to the vocabulary reaches the threshold: ``(key, similarity)``.

    Without vocabulary vectors everything passes.
    """
    if vocabulary.isEmpty():
        return df.select(key, F.lit(None).cast("double").alias("similarity"))
    return best_match(df, key, vec, vocabulary).filter(
        F.col("similarity") >= threshold).select(key, "similarity")
