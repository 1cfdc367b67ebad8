"""Word and shingle hashes of Arrow text columns, vectorised over whole batches.

All hashes are 64-bit: a word's is a polynomial in its bytes with a random
64-bit number per byte value, finished by a mixer. Inputs are whole texts of
any length; working memory is bounded by ``SEGMENT`` bytes of text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

U64 = np.uint64
SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTES = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_LOWER = _BYTES.copy()
_LOWER[ord("A"):ord("Z") + 1] = _BYTES[ord("a"):ord("z") + 1]
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, dtype=U64), "down": np.ones(1, dtype=U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, dtype=U64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=U64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and where each text begins; NULL is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[at[0]:at[-1]], at - at[0]


def _segments(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``SEGMENT`` bytes that do not cut a word of a text."""
    a = 0
    while a < len(data):
        b = min(len(data), a + SEGMENT)
        while b < len(data) and not _SPACES[data[b]]:
            at = np.searchsorted(bounds, b)
            near = int(bounds[at]) if at < len(bounds) else len(data)
            if near == b:
                break
            spaces = np.flatnonzero(_SPACES[data[b:min(b + 65_536, near)]])
            b = b + int(spaces[0]) if len(spaces) else min(b + 65_536, near)
        yield a, b
        a = b


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word between ASCII white space, in order.

    ``bounds`` are places at which a word ends in any case. With ``lower`` A-Z
    count as a-z.
    """
    table = _LOWER if lower else _BYTES
    hashes, places = [np.empty(0, U64)], [np.empty(0, np.int64)]
    for a, b in _segments(data, bounds):
        part = data[a:b]
        space = _SPACES[part]
        cut = np.zeros(len(part) + 1, dtype=bool)
        cut[[0, -1]] = True
        inner = bounds[np.searchsorted(bounds, a):np.searchsorted(bounds, b)]
        cut[inner - a] = True
        word = ~space
        starts = np.flatnonzero(word & (cut[:-1] | np.concatenate([[True], space[:-1]])))
        ends = np.flatnonzero(word & (cut[1:] | np.concatenate([space[1:], [True]])))
        up, down = powers(len(part))
        sums = np.cumsum(np.where(space, U64(0), table[part]) * up, dtype=U64)
        before = np.where(starts > 0, sums[starts - 1], U64(0))
        before[starts == 0] = 0
        hashes.append(mix((sums[ends] - before) * down[starts] + (ends - starts).astype(U64)))
        places.append(starts + a)
    return np.concatenate(hashes), np.concatenate(places)


def chain(words: np.ndarray, size: int) -> np.ndarray:
    """Order-dependent hash of every ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    acc = np.full(n, size, dtype=U64)
    for i in range(size):
        acc = mix(acc * U64(_BASE) + words[i:i + n])
    return acc


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its ``size``-word shingles.

    A text of fewer words is one shingle, a text without words an empty set.
    """
    data, bounds = text_bytes(column)
    words, places = word_hashes(data, bounds)
    first = np.searchsorted(places, bounds)
    shingles = chain(words, size)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            sets.append(np.unique(shingles[a:b - size + 1]))
        else:
            sets.append(chain(words[a:b], b - a) if b > a else np.empty(0, U64))
    return sets


def pack_text(column: pa.Array) -> pa.Array:
    """Texts as zstandard frames, for the way through a shuffle; NULL stays NULL."""
    coder = zstandard.ZstdCompressor(level=1)
    return pa.array([None if t is None else coder.compress(t.encode()) for t in column.to_pylist()], pa.binary())


def unpack_text(column: pa.Array) -> pa.Array:
    coder = zstandard.ZstdDecompressor()
    return pa.array([None if t is None else coder.decompress(t).decode() for t in column.to_pylist()], pa.string())
