"""An adaptive context-mixing range coder for token ids, in independent blocks.

A block holds one sequence of ids, cut into lanes of equal length that are
coded in lockstep: at every step one id of each lane, under a model that all
lanes share and that learns from the step's ids afterwards. Vectors over the
lanes do the work, in the encoder and in the decoder.

The model mixes three predictions: the id that last followed the two ids
before (order 2), the one that followed the id before (order 1), and the
frequencies of all ids so far (order 0). How far the first two are trusted is
learned per class of their confidences. An id takes the interval of the
highest order that predicts it, else its share of the order-0 rest.

Layout, little-endian: magic ``VTR1``; ids, lanes, vocabulary as u32; crc32 of
the ids and of what follows as u32; words per lane as u32; the lanes' words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U64 = np.uint64
MAGIC = b"VTR1"
HEADER = "<4sIIIII"
SCALE, SHARE = 24, 20              # bits of all intervals together; of the order-0 table
LANES, STEPS, REFRESH = 4096, 128, 8
TABLE = 18                         # bits of the order-2 table
TRUST = 7                          # highest confidence
LEAST = 1 << SHARE                 # what order 0 keeps of an interval at least


class Model:
    """Predictions for one step of all lanes; the same in encoder and decoder."""

    def __init__(self, lanes: int, vocabulary: int) -> None:
        self.counts = np.ones(vocabulary, dtype=np.int64)
        self.pending: list[np.ndarray] = []
        self.last1 = np.zeros(lanes, dtype=np.int64)
        self.last2 = np.zeros(lanes, dtype=np.int64)
        self.guess1, self.sure1 = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64)
        self.guess2, self.sure2 = np.zeros(1 << TABLE, np.int64), np.zeros(1 << TABLE, np.int64)
        classes = 2 * (TRUST + 1) ** 2
        self.seen = np.tile(np.array([0.3, 0.2, 1.0]), (classes, 1))
        self.step = 0
        self._table()

    def _table(self) -> None:
        total = int(self.counts.sum())
        room = (1 << SHARE) - len(self.counts)
        share = 1 + self.counts * room // total
        share[int(self.counts.argmax())] += (1 << SHARE) - int(share.sum())
        self.below = np.concatenate([[0], np.cumsum(share)])

    def predict(self) -> None:
        self.slot2 = ((self.last1 * 40_503 + self.last2 * 2_654_435_761) >> 7) & ((1 << TABLE) - 1)
        self.two, self.one = self.guess2[self.slot2], self.guess1[self.last1]
        self.trust2, self.trust1 = self.sure2[self.slot2], self.sure1[self.last1]
        self.kind = ((self.trust2 * (TRUST + 1) + self.trust1) << 1) + (self.two == self.one)
        share = self.seen[:, :2] / self.seen.sum(axis=1, keepdims=True)
        wide = ((1 << SCALE) - LEAST) * share
        wide = np.maximum(1, wide.astype(np.int64))
        self.width2, self.width1 = wide[self.kind, 0], wide[self.kind, 1]
        self.rest = (1 << SCALE) - self.width2 - self.width1

    def intervals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of each lane's id, out of ``2 ** SCALE``."""
        low = self.below[ids] * self.rest >> SHARE
        high = self.below[ids + 1] * self.rest >> SHARE
        is2 = ids == self.two
        is1 = ~is2 & (ids == self.one)
        start = np.where(is2, 0, np.where(is1, self.width2, low + self.width2 + self.width1))
        return start, np.where(is2, self.width2, np.where(is1, self.width1, high - low))

    def find(self, at: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold the places ``at``."""
        inner = at - self.width2 - self.width1
        share = (((np.maximum(inner, 0) + 1) << SHARE) - 1) // self.rest
        zero = np.searchsorted(self.below, share, side="right") - 1
        return np.where(at < self.width2, self.two, np.where(inner < 0, self.one, zero))

    def learn(self, ids: np.ndarray) -> None:
        is2, is1 = ids == self.two, ids == self.one
        result = np.where(is2, 0, np.where(is1, 1, 2))
        self.seen += np.bincount(self.kind * 3 + result, minlength=self.seen.size).reshape(self.seen.shape)
        # a right guess gains trust, a wrong one loses half and is replaced at none
        self.sure2[self.slot2] = np.where(is2, np.minimum(self.trust2 + 1, TRUST), self.trust2 >> 1)
        self.guess2[self.slot2] = np.where(is2 | (self.trust2 > 1), self.two, ids)
        self.sure1[self.last1] = np.where(is1, np.minimum(self.trust1 + 1, TRUST), self.trust1 >> 1)
        self.guess1[self.last1] = np.where(is1 | (self.trust1 > 1), self.one, ids)
        self.last2, self.last1 = self.last1, ids
        self.pending.append(ids)
        self.step += 1
        # early on every step counts
        if len(self.pending) == REFRESH or self.step < 4 * REFRESH:
            self.counts += 32 * np.bincount(np.concatenate(self.pending), minlength=len(self.counts))
            self.pending = []
            self._table()


def shape_of(n: int) -> tuple[int, int]:
    """Lanes and steps for ``n`` ids."""
    lanes = max(1, min(LANES, n // STEPS))
    return lanes, -(-n // lanes)


def encode_block(ids: np.ndarray) -> bytes:
    """One self-contained block; any ids below 2 ** 20 - 1, none at all included."""
    n = len(ids)
    if not n:
        return struct.pack(HEADER, MAGIC, 0, 0, 0, 0, zlib.crc32(b""))
    vocabulary = int(ids.max()) + 1
    lanes, steps = shape_of(n)
    grid = np.zeros(lanes * steps, dtype=np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(lanes, vocabulary)
    low, width = np.zeros(lanes, U64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U64)
    # a step gives off one word at most, the end two
    out, size = np.zeros((lanes, steps + 2), np.uint32), np.zeros(lanes, np.int64)
    for t in range(steps):
        model.predict()
        start, span = model.intervals(grid[t])
        unit = width >> U64(SCALE)
        new = low + unit * start.astype(U64)
        carry = np.flatnonzero(new < low)
        place = size[carry] - 1
        while len(carry):                    # add one to the number written so far
            out[carry, place] += np.uint32(1)
            more = out[carry, place] == 0
            carry, place = carry[more], place[more] - 1
        low, width = new, unit * span.astype(U64)
        short = np.flatnonzero(width < U64(1 << 32))
        out[short, size[short]] = (low[short] >> U64(32)).astype(np.uint32)
        size[short] += 1
        low[short] <<= U64(32)
        width[short] <<= U64(32)
        model.learn(grid[t])
    rows = np.arange(lanes)
    for part in (low >> U64(32), low & U64(0xFFFFFFFF)):
        out[rows, size] = part.astype(np.uint32)
        size += 1
    words = out[np.arange(out.shape[1]) < size[:, None]]
    body = size.astype("<u4").tobytes() + words.astype("<u4").tobytes()
    check = zlib.crc32(ids.astype("<u4").tobytes())
    return struct.pack(HEADER, MAGIC, n, lanes, vocabulary, check, zlib.crc32(body)) + body


def decode_block(block: bytes) -> np.ndarray:
    """The ids of a block; a damaged one is an error."""
    magic, n, lanes, vocabulary, check, body_check = struct.unpack_from(HEADER, block)
    body = block[struct.calcsize(HEADER):]
    if magic != MAGIC or zlib.crc32(body) != body_check:
        raise ValueError("damaged block")
    if not n:
        return np.empty(0, np.uint32)
    steps = -(-n // lanes)
    size = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    words = np.append(np.frombuffer(body, "<u4", offset=4 * lanes).astype(U64), U64(0))
    at = np.cumsum(size) - size
    code = (words[at] << U64(32)) | words[at + 1]
    at = at + 2
    width = np.full(lanes, 0xFFFFFFFFFFFFFFFF, U64)
    model = Model(lanes, vocabulary)
    grid = np.empty((steps, lanes), dtype=np.uint32)
    for t in range(steps):
        model.predict()
        unit = width >> U64(SCALE)
        place = np.minimum(code // unit, U64((1 << SCALE) - 1)).astype(np.int64)
        ids = model.find(place)
        start, span = model.intervals(ids)
        code = code - unit * start.astype(U64)
        width = unit * span.astype(U64)
        short = np.flatnonzero(width < U64(1 << 32))
        code[short] = (code[short] << U64(32)) | words[at[short]]
        width[short] <<= U64(32)
        at[short] += 1
        model.learn(ids)
        grid[t] = ids
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise ValueError("damaged block")
    return ids
