"""Token counts of the sections of documents, by the places of their tokens."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import bound_batches

OUTSIDE = -1
SPAN = "array<struct<start:int,stop:int>>"


def load_ranks(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """A byte-level BPE from its rank file, and the number of bytes of every id."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


def line_sections(text: Column) -> Column:
    """Each line with the line break that ends it, as character spans."""
    lengths = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(x) + 1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))
    total = F.length(F.coalesce(text, F.lit("")))
    add = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["spans"], F.array(F.struct(
        acc["at"].alias("start"), F.least(acc["at"] + n, total).alias("stop")))).alias("spans"))
    return F.aggregate(lengths, zero, add)["spans"]


def field_sections(*fields: Column, between: int = 1) -> Column:
    """Spans of fields that are joined with ``between`` characters in the middle; NULL is empty."""
    at, spans = F.lit(0), []
    for field in fields:
        stop = at + F.coalesce(F.length(field), F.lit(0))
        spans.append(F.struct(at.alias("start"), stop.alias("stop")))
        at = stop + between
    return F.array(*spans)


def attribute(starts: np.ndarray, stops: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The section of each token: an interval join of two sorted lists of byte spans.

    A token goes to the section that holds most of its bytes, of equal ones to
    the earlier, and to ``OUTSIDE`` if it touches none. Sections may not overlap.
    """
    filled = np.flatnonzero(last > first)
    lo, hi = first[filled], last[filled]
    if (lo[1:] < hi[:-1]).any():
        raise ValueError("sections overlap")
    if not len(filled):
        return np.full(len(starts), OUTSIDE)
    best = np.searchsorted(hi, starts, side="right")
    inside = best < len(hi)
    at = np.minimum(best, len(hi) - 1)
    share = np.where(inside, np.minimum(stops, hi[at]) - np.maximum(starts, lo[at]), 0)
    # tokens that run past the end of their section may hold more of a later one
    for t in np.flatnonzero(inside & (stops > hi[at])):
        for s in range(at[t] + 1, len(hi)):
            if lo[s] >= stops[t]:
                break
            held = min(stops[t], hi[s]) - lo[s]
            if held > share[t]:
                at[t], share[t] = s, held
    return np.where(share > 0, filled[at], OUTSIDE)


def token_counts(docs: DataFrame, path: str, pattern: str, sections: Column | None = None,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens per section: ``doc_id, section, start, stop, n_tokens, n_crossing``.

    A document is encoded whole, once; each token's bytes are placed by the
    sizes of the tokens before it, and the token is counted in the section that
    holds most of them (``attribute``). So sections add up to the document,
    unlike texts that are cut before encoding. ``n_crossing`` counts the
    section's tokens that lie partly outside it. ``sections`` is an array of
    ``struct<start, stop>`` in characters, lines by default; they are numbered
    from 0 in their order and may leave gaps, but not overlap; spans beyond the
    text end at its end. Tokens that touch no section form section -1, without
    a span, if there are any. A NULL text counts as empty; a NULL list of
    sections as none. One group of rows per input row, also for repeated ids;
    other columns are ignored. ``path`` is the tokenizer's rank file.
    """
    bound_batches(docs.sparkSession)
    spans = line_sections(F.col(text)) if sections is None else sections
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), spans.cast(SPAN).alias("spans"))
    schema = T.StructType([source.schema["doc_id"], *(T.StructField(n, T.IntegerType()) for n in (
        "section", "start", "stop", "n_tokens", "n_crossing"))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, size = load_ranks(path, pattern)
        for big in batches:
            for first in range(0, len(big), 1024):
                batch = big.slice(first, 1024)
                rows: list[np.ndarray] = []
                for row, (value, span) in enumerate(zip(batch.column(1), batch.column(2))):
                    found = _sections_of(value.as_py() or "", span, coder, size)
                    rows.append(np.column_stack([np.full(len(found), row), found]))
                flat = np.concatenate(rows) if rows else np.empty((0, 6), np.int64)
                outside = flat[:, 1] == OUTSIDE
                columns = [pa.array(flat[:, i].astype(np.int32), mask=outside if i in (2, 3) else None)
                           for i in range(1, 6)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(flat[:, 0])), *columns], schema.names)

    return source.mapInArrow(count, schema)


def _sections_of(text: str, span: pa.Scalar, coder: tiktoken.Encoding, size: np.ndarray) -> np.ndarray:
    """Rows of section, start, stop, tokens, crossing tokens."""
    if span.is_valid and len(span.values):
        start = span.values.field("start").to_numpy()
        stop = span.values.field("stop").to_numpy()
    else:
        start = stop = np.empty(0, np.int64)
    ids = coder.encode_to_numpy(text, disallowed_special=())
    stops = np.cumsum(size[ids])
    starts = stops - size[ids]
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))     # byte of each character
    start, stop = np.minimum(start, len(at) - 1), np.minimum(stop, len(at) - 1)
    owner = attribute(starts, stops, at[start], at[stop])
    tokens = np.bincount(owner + 1, minlength=len(start) + 1)
    named = owner >= 0
    over = named.copy()
    over[named] = (starts[named] < at[start][owner[named]]) | (stops[named] > at[stop][owner[named]])
    crossing = np.bincount(owner[over], minlength=len(start))
    rows = np.column_stack([np.arange(len(start)), start, stop, tokens[1:], crossing]).astype(np.int64)
    return np.concatenate([rows, [[OUTSIDE, 0, 0, tokens[0], 0]]]) if tokens[0] else rows
