"""Vector code compression: product codes learned by integer k-means, searched in the Walsh-Hadamard domain."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

INT_LIMIT = 1 << 62      # beyond this a sum of squares leaves int64 and Python integers take over


def sequency_hadamard(size: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of ``size`` (a power of two), rows by number of sign changes."""
    h = np.ones((1, 1), dtype=np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    changes = (np.diff(h, axis=1) != 0).sum(axis=1)
    return h[np.argsort(changes, kind="stable")]


def dyadic(size: int) -> list[tuple[int, int]]:
    """Coefficient blocks in sequency order: [0, 1), [1, 2), [2, 4), [4, 8), ..."""
    out, start = [(0, 1)], 1
    while start < size:
        out.append((start, 2 * start))
        start *= 2
    return out


class Transformed:
    """A part's codebook in the transform domain: ``size`` the padded width, ``entries`` the coefficients."""

    def __init__(self, entries: np.ndarray):
        self.width = entries.shape[1]
        self.size = 1 << max(0, (self.width - 1).bit_length())
        self.h = sequency_hadamard(self.size)[:, :self.width]      # the padding's zeros add nothing
        self.entries = entries @ self.h.T


def nearest(part: np.ndarray, book: Transformed) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (squared distance, ties to the lower index) and that distance, exactly.

    Both sides are transformed; ``|H(x - c)|^2 = size * |x - c|^2``. The first
    coefficient picks a first guess, whose whole distance bounds the rest;
    squared differences of the other entries are added block by block in
    sequency order, and an entry leaves as soon as its partial sum passes the
    bound. Only entries still alive are computed.
    """
    x = part @ book.h.T
    c = book.entries
    n, k = len(x), len(c)
    index = np.arange(k)
    partial = (x[:, :1] - c[None, :, 0]) ** 2
    guess = np.argmin(partial, axis=1)
    best = ((x - c[guess]) ** 2).sum(axis=1)

    def alive_now() -> np.ndarray:
        return (partial < best[:, None]) | ((partial == best[:, None]) & (index[None, :] < guess[:, None]))

    alive = alive_now()
    alive[np.arange(n), guess] = False
    for start, stop in dyadic(book.size)[1:]:
        rows, ents = np.nonzero(alive)
        if not len(rows):
            break
        partial[rows, ents] += ((x[rows, start:stop] - c[ents, start:stop]) ** 2).sum(axis=1)
        alive &= alive_now()
    masked = np.where(alive, partial, partial.max(initial=0) + best.max(initial=0) + 1)
    other = np.argmin(masked, axis=1)
    value = masked[np.arange(n), other]
    wins = alive[np.arange(n), other] & ((value < best) | ((value == best) & (other < guess)))
    return np.where(wins, other, guess), np.where(wins, value, best) // book.size


def exact_kind(values: np.ndarray, books: list[np.ndarray], size: int) -> np.ndarray:
    """int64 while every sum of squares fits, else Python integers."""
    largest = max([int(np.abs(values).max(initial=0))] + [int(np.abs(b).max(initial=0)) for b in books])
    return values if 4 * size ** 3 * (largest + 1) ** 2 < INT_LIMIT else values.astype(object)


def assign(values: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, parts) and squared errors (n, parts) of integer vectors (n, dim) against each part's entries."""
    parts = len(books)
    width = values.shape[1] // parts if parts else 0
    size = 1 << max(0, (width - 1).bit_length())
    values = exact_kind(values, books, size)
    codes, errors = [], []
    for p, book in enumerate(books):
        code, error = nearest(values[:, p * width:(p + 1) * width], Transformed(exact_kind(book, books, size)))
        codes.append(code)
        errors.append(error)
    return np.stack(codes, axis=1), np.stack(errors, axis=1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(len(column), dim)


def quantise(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def valid(vector: Column) -> Column:
    """Not NULL, and no component NULL, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~bad


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                 parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """Product codes of every valid vector: ``vec_id, code, error, label_error, codebooks_sha256``.

    Rows whose vector is NULL or holds a NULL or non-finite component are
    dropped, and so are vectors whose length differs from that of the vector of
    the smallest id (which sets the width; parts are its consecutive eighths,
    the last ones shorter if it does not divide). Components become
    ``floor(scale * x)``. Each part's codebook starts from that part of the
    ``entries`` smallest ids, ascending (fewer rows give fewer entries; a NULL
    id is coded but seeds nothing). Each of ``rounds`` rounds assigns every
    part to the nearest entry (``nearest``: squared distance, ties to the lower
    index) and moves each used entry to the componentwise floor of its parts'
    mean; unused entries stay. ``code`` is two hex digits an index, in part
    order; ``error`` the final squared distances summed over parts;
    ``label_error`` the errors summed over rows of one label, NULL labels
    together; ``codebooks_sha256`` the sha256 of all final components by
    part, entry and position, comma-joined. Repeated rows are coded one by
    one. An empty table, or one without valid rows, gives an empty one.
    The search is exact at any size (Python integers where int64 could
    overflow); ``error`` and ``label_error`` must fit in a long.

    Vectors are quantised and written once; each round is a map over them
    that sums its parts per entry inside the task, then a combine of at most
    parts * entries * width numbers. Codebooks, of that size, are the only
    thing sent to the driver and back.
    """
    source = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"),
                            F.col(vector).alias("_v"))
    kept = source.filter(valid(F.col("_v")))
    first = kept.filter(F.col("vec_id").isNotNull()).orderBy("vec_id").select(F.size("_v")).first()
    if first is None:
        return source.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    dim = first[0]
    ints = stage(kept.filter(F.size("_v") == dim).select("vec_id", "label", quantise(F.col("_v"), scale).alias("q")))
    # a top-k: each task keeps its ``entries`` smallest ids before they meet
    seeds = ints.filter(F.col("vec_id").isNotNull()).orderBy("vec_id").limit(entries).select("q").collect()
    width = -(-dim // parts)
    cuts = [(min(p * width, dim), min((p + 1) * width, dim)) for p in range(parts)]
    start = np.array([list(r[0]) for r in seeds], dtype=np.int64).reshape(len(seeds), dim)
    books = [start[:, a:b].copy() for a, b in cuts]
    for _ in range(rounds):
        books = _round(ints, books, cuts, dim)
    return _final(ints, books, cuts, dim)


def _padded(values: np.ndarray, books: list[np.ndarray], cuts: list[tuple[int, int]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Parts padded to one width with zeros, which change no distance."""
    width = max((b - a for a, b in cuts), default=0)
    out = np.zeros((len(values), width * len(cuts)), dtype=np.int64)
    padded = []
    for p, (a, b) in enumerate(cuts):
        out[:, p * width:p * width + (b - a)] = values[:, a:b]
        book = np.zeros((len(books[p]), width), dtype=np.int64)
        book[:, :b - a] = books[p]
        padded.append(book)
    return out, padded


def _round(ints: DataFrame, books: list[np.ndarray], cuts: list[tuple[int, int]], dim: int) -> list[np.ndarray]:
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # per task: counts and componentwise sums per (part, entry), as Python integers across batches
        counts = [np.zeros(len(b), dtype=object) for b in books]
        totals = [np.zeros(b.shape, dtype=object) for b in books]
        for batch in batches:
            values, padded = _padded(_matrix(batch.column("q"), dim), books, cuts)
            codes, _ = assign(values, padded)
            width = values.shape[1] // len(cuts)
            for p, (a, b) in enumerate(cuts):
                part = exact_kind(values[:, p * width:p * width + (b - a)], [], 1)
                batch_sums = np.zeros((len(books[p]), b - a), dtype=part.dtype)
                np.add.at(batch_sums, codes[:, p], part)
                totals[p] += batch_sums.astype(object)
                counts[p] += np.bincount(codes[:, p], minlength=len(books[p])).astype(object)
        keys = [(p, e) for p in range(len(books)) for e in range(len(books[p])) if counts[p][e]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in keys], pa.int32()), pa.array([e for _, e in keys], pa.int32()),
             pa.array([int(counts[p][e]) for p, e in keys], pa.int64()),
             pa.array([[str(v) for v in totals[p][e]] for p, e in keys], pa.list_(pa.string()))],
            ["part", "entry", "n", "sums"])

    schema = "part int, entry int, n long, sums array<string>"
    partial = ints.select("q").mapInArrow(sums, schema)
    # at most parts * entries rows of width numbers: the decimal sum is exact for any count
    exploded = partial.select("part", "entry", "n", F.posexplode("sums").alias("pos", "s"))
    merged = exploded.groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"),
                                                          F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = [b.copy() for b in books]
    for r in merged:
        out[r.part][r.entry, r.pos] = int(r.s) // int(r.n)      # floor, also below zero
    return out


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for row in b for v in row).encode()).hexdigest()


def _final(ints: DataFrame, books: list[np.ndarray], cuts: list[tuple[int, int]], dim: int) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, padded = _padded(_matrix(batch.column("q"), dim), books, cuts)
            codes, errors = assign(values, padded)
            text = ["".join(f"{int(c):02x}" for c in row) for row in codes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()),
                 pa.array([int(e) for e in errors.sum(axis=1)], pa.int64())], ["vec_id", "label", "code", "error"])

    label_type = dict(ints.dtypes)["label"]
    coded = stage(ints.mapInArrow(code, f"vec_id long, label {label_type}, code string, error long"))
    per_label = stage(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    joined = coded.join(per_label, coded["label"].eqNullSafe(per_label["label"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
