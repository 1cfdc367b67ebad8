"""Language-model scoring with a probabilistic suffix tree learned from the corpus."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import ExitStack
from functools import partial
from itertools import chain, groupby
from tempfile import SpooledTemporaryFile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .text import bound_batches, map_arrow, release_memory

CHUNK = 16 << 20          # bytes of text cut into tokens at a time
BUCKET = 128 << 20        # bytes of text whose tokens make a bucket, at most about; buckets number 2^16 at most
PART = 8 << 20            # bytes of text whose tokens make a part of a bucket, about
HEAVY = 1 << 20           # a word of more training tokens has its contexts dealt over parts of their own
PENDING = 1 << 21         # rows held before equal ones are added up
BATCH = 8 << 20           # bytes of blocks handed to Python at a time
SPOOL = 64 << 20          # bytes of a bucket's blocks held in memory; more go to temporary files

WORDS = "name long, word string, n long, buckets binary"
BLOCKS = "bucket int, names binary, docs binary, parts array<int>, ids array<binary>"
COUNTED = f"{BLOCKS}, n long, v long, clash boolean, heavy array<long>"
SUMS = "_row long, n_tokens long, n_known long, base_score double, score double"


def pack(values: np.ndarray) -> bytes:
    """Numbers as a zstandard frame, first all their lowest bytes, then the next ones."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(frame: bytes, dtype: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def runs(ordered: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of every run of equal numbers."""
    cuts = np.flatnonzero(np.diff(ordered)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(ordered)]) if len(ordered) else iter(())


def word_names(words: pa.Array, salt: int) -> np.ndarray:
    """64-bit names of words; ``salt`` changes every name. 0 comes first and names the place before a text."""
    names = pd.util.hash_array(words.cast(pa.large_binary()).to_numpy(zero_copy_only=False), hash_key=f"{salt:016d}",
                               categorize=False)
    return np.concatenate([np.zeros(1, np.uint64), np.maximum(names, np.uint64(1))])


class Tokens:
    """Tokens of some texts: ``words`` (distinct), ``ids`` (1-based place in ``words``), ``doc`` and ``at`` (place in it).

    Tokens are A-Z lower-cased words between ASCII white space, then the end,
    which is the empty word; NULL is empty.
    """

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
        flat = lists.flatten()
        real = pc.not_equal(flat, "")
        owner = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(owner), dtype=np.int32), owner)[real.to_numpy(zero_copy_only=False)]
        coded = flat.filter(real).dictionary_encode()
        del lists, flat
        sizes = np.bincount(doc, minlength=len(owner)) + 1
        ends = np.cumsum(sizes)
        self.words = pa.concat_arrays([coded.dictionary, pa.array([""], pa.large_string())])
        self.ids = np.full(ends[-1] if len(ends) else 0, len(self.words), np.int32)
        word = np.ones(len(self.ids), bool)
        word[ends - 1] = False
        self.ids[word] = coded.indices.to_numpy(zero_copy_only=False) + 1
        self.doc = np.repeat(np.arange(len(owner), dtype=np.int32), sizes)
        self.at = np.arange(len(self.ids), dtype=np.int32) - (ends - sizes).astype(np.int32)[self.doc]

    def before(self, k: int) -> np.ndarray:
        """The id of the k-th token before each, 0 before a text."""
        ids = np.zeros_like(self.ids)
        ids[k:] = self.ids[:-k]
        ids[self.at < k] = 0
        return ids

    def buckets(self, names: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """The bucket of each token: that of the word before it; first tokens have none and go by their row."""
        h1 = self.before(1)
        of_word, of_row = (names % np.uint64(n)).astype(np.int32), (rows % n).astype(np.int32)
        return np.where(h1 > 0, of_word[h1], of_row[self.doc])


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Tokens]]:
    """Rows, training flags and tokens of about ``CHUNK`` bytes of text at a time."""
    def cut(tables: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, Tokens]:
        whole = pa.Table.from_batches(tables).combine_chunks()
        rows, held, texts = (whole.column(c).combine_chunks() for c in ("_row", "held_out", "_text"))
        return rows.to_numpy(), ~held.to_numpy(zero_copy_only=False), Tokens(texts)

    held, size = [], 0
    for batch in batches:
        lengths = np.cumsum(pc.binary_length(batch.column("_text")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        for a, b in runs(lengths // CHUNK):     # a batch of long texts is cut between its rows
            held.append(batch.slice(a, b - a))
            size += int(lengths[b - 1] - (lengths[a - 1] if a else 0))
            if size >= CHUNK:
                yield cut(held)
                held, size = [], 0
                release_memory()
    if held:
        yield cut(held)


def count_words(batches: Iterator[pa.RecordBatch], buckets: int, salt: int) -> Iterator[pa.RecordBatch]:
    """Per chunk each distinct word with its name, its training tokens and the buckets that ask for its count."""
    def count(chunk: tuple) -> pa.RecordBatch:
        rows, train, tokens = chunk
        names = word_names(tokens.words, salt)
        n = np.bincount(tokens.ids - 1, weights=train[tokens.doc], minlength=len(tokens.words)).astype(np.int64)
        asked = np.unique(tokens.ids.astype(np.int64) * buckets + tokens.buckets(names, rows, buckets))
        offsets = 2 * np.searchsorted(asked // buckets, np.arange(1, len(names) + 1))
        lists = pa.Array.from_buffers(pa.large_binary(), len(names) - 1, [
            None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer((asked % buckets).astype(np.uint16))])
        return pa.RecordBatch.from_arrays(
            [pa.array(names[1:].view(np.int64)), tokens.words.cast(pa.string()), pa.array(n), lists.cast(pa.binary())],
            names=["name", "word", "n", "buckets"])

    return map(count, chunks(batches))       # map lets go of a chunk before the next is cut


BLOCK = pa.schema([("bucket", pa.int32()), ("names", pa.binary()), ("docs", pa.binary()), ("parts", pa.list_(pa.int32())),
                   ("ids", pa.list_(pa.binary()))])
TOTAL = pa.schema([*BLOCK, ("n", pa.int64()), ("v", pa.int64()), ("clash", pa.bool_()), ("heavy", pa.list_(pa.int64()))])


def add_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of a partition, sorted by name, as blocks for the buckets that asked, and their totals.

    ``clash`` tells that two distinct words share a name.
    """
    totals = {"n": 0, "v": 0, "clash": False, "heavy": []}

    def add(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table = table.combine_chunks()
        name = table.column("name").to_numpy()
        first = np.concatenate([[True], name[1:] != name[:-1]])
        words = table.column("word").combine_chunks()
        other = pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)
        c = np.add.reduceat(table.column("n").to_numpy(), np.flatnonzero(first))
        names = name[first]
        totals["n"] += int(c.sum())
        totals["v"] += int((c > 0).sum())
        totals["clash"] |= bool((other & ~first[1:]).any())
        totals["heavy"] += names[c > HEAVY].tolist()
        lists = table.column("buckets").combine_chunks()
        word = np.repeat(np.cumsum(first) - 1, pc.binary_length(lists).to_numpy() // 2)
        asked = np.frombuffer(b"".join(lists.to_pylist()), np.uint16).astype(np.int64)
        pairs = np.unique((word << 32) | asked)
        pairs = pairs[c[pairs >> 32] > 0]
        return pairs & 0xFFFFFFFF, names[pairs >> 32], c[pairs >> 32]

    def blocks(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        bucket, name, c = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((name, bucket))
        bucket, name, c = bucket[order], name[order], c[order]
        for a, b in runs(bucket):
            yield pa.RecordBatch.from_pylist([{"bucket": int(bucket[a]), "names": pack(name[a:b]), "ids": [pack(c[a:b])]}],
                                             TOTAL)

    rest, parts = None, []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not len(table):
            continue
        name = table.column("name").to_numpy()
        last = int(np.searchsorted(name, name[-1]))     # rows of the last name may go on in the next batch
        rest = table.slice(last)
        if last:
            parts.append(add(table.slice(0, last)))
        if sum(len(p[0]) for p in parts) >= PENDING:
            yield from blocks(parts)
            parts = []
    if rest is not None:
        parts.append(add(rest))
        yield from blocks(parts)
        yield pa.RecordBatch.from_pylist([totals], TOTAL)


def cut_events(batches: Iterator[pa.RecordBatch], depth: int, buckets: int, salt: int, light: int, heavy: list[int],
               dealt: int) -> Iterator[pa.RecordBatch]:
    """Tokens with the ``depth`` words before them, as one block a chunk and bucket.

    A block numbers its own words by falling frequency, so that an event takes
    few bytes: ``ids`` holds, for each of ``parts``, a column for each word
    before, the token and the place of its document in ``docs`` (twice the
    row, plus 1 if learned from). Words before go to ``light`` parts whole;
    contexts of a heavy one are dealt by the next word over ``dealt`` more.
    """
    def cut(chunk: tuple) -> Iterator[pa.RecordBatch]:
        rows, train, tokens = chunk
        names = word_names(tokens.words, salt)
        columns = [*[tokens.before(k) for k in range(1, depth + 1)], tokens.ids]
        part = ((names // np.uint64(buckets)) % np.uint64(light)).astype(np.int32)[columns[0]]
        if heavy:
            piece = light + (names % np.uint64(dealt)).astype(np.int32)[columns[1]]
            part = np.where(np.isin(names, np.array(heavy, np.int64).view(np.uint64))[columns[0]], piece, part)
        key = tokens.buckets(names, rows, buckets).astype(np.int64) * (light + dealt) + part
        key = key.astype(np.min_scalar_type(int(key.max())))
        order = np.argsort(key, kind="stable")
        key = key[order]
        for a, b in runs(key // (light + dealt)):
            at, own = order[a:b], key[a:b]
            ids = [c[at] for c in columns]
            n = sum(np.bincount(i, minlength=len(names)) for i in ids)
            words = np.flatnonzero(n)
            words = words[np.argsort(-n[words], kind="stable")]
            rank = np.empty(len(names), np.uint32)
            rank[words] = np.arange(len(words))
            n_of = np.bincount(tokens.doc[at], minlength=len(rows)) > 0
            docs, doc = np.flatnonzero(n_of), (np.cumsum(n_of) - 1).astype(np.uint32)[tokens.doc[at]]
            ids = [*[rank[i] for i in ids], doc]
            cuts = list(runs(own))
            yield pa.RecordBatch.from_pylist([{
                "bucket": int(own[0]) // (light + dealt), "names": pack(names[words]),
                "docs": pack(np.diff(2 * rows[docs] + train[docs], prepend=0)),
                "parts": [int(own[i]) % (light + dealt) for i, _ in cuts],
                "ids": [pack(np.concatenate([c[i:j] for c in ids])) for i, j in cuts]}], BLOCK)

    return chain.from_iterable(map(cut, chunks(batches)))


class Tally:
    """Rows of integer columns with numbers to add up; equal rows are added up whenever many have gathered."""

    def __init__(self, columns: int):
        self.columns, self.parts, self.size, self.limit = columns, [], 0, PENDING
        self.merged = False

    def add(self, *arrays: np.ndarray) -> None:
        self.parts.append(arrays)
        self.size += len(arrays[0])
        if self.size > self.limit:
            self.parts, self.merged = [self.summed()], True
            self.size = len(self.parts[0][0])
            self.limit = max(PENDING, 2 * self.size)

    def gathered(self) -> list[np.ndarray]:
        """The columns and numbers, in their order unless ``merged``; a row may come more than once."""
        return [np.concatenate(x) for x in zip(*self.parts)]

    def summed(self) -> list[np.ndarray]:
        arrays = self.gathered()
        order = np.lexsort(arrays[:self.columns])
        arrays = [a[order] for a in arrays]
        first = np.flatnonzero(np.concatenate(
            [[True], np.any([a[1:] != a[:-1] for a in arrays[:self.columns]], axis=0)]))
        return [a[first] if i < self.columns else np.add.reduceat(a, first) for i, a in enumerate(arrays)]


class Level:
    """Contexts of one length: their counts, and whether they are kept.

    Built from n-grams: the ids ``up`` of their shorter contexts, the word
    before these (0: none), the token ``x``, training counts ``n``, and the
    counts ``n_p`` and ``n_px`` of the shorter context and of it with ``x``.
    ``at`` and ``pair`` give the context of each n-gram, and it with ``x``.
    """

    def __init__(self, up, word, x, n, n_p, n_px, m: int, min_count: int, threshold: float):
        self.m = m
        self.keys, at = np.unique(up * m + word, return_inverse=True)
        self.pairs, self.first, pair = np.unique(at * m + x, return_index=True, return_inverse=True)
        self.at, self.pair = at.astype(np.int32), pair.astype(np.int32)
        self.n_cx = np.bincount(pair, weights=n)
        owner, size = self.pairs // m, len(self.keys)
        self.n_c = np.bincount(owner, weights=self.n_cx, minlength=size)
        self.u_c = np.bincount(owner, weights=self.n_cx > 0, minlength=size)
        with np.errstate(divide="ignore", invalid="ignore"):
            term = self.n_cx * np.log((self.n_cx / self.n_c[owner]) / (n_px[self.first] / n_p[self.first]))
        g = 2 * np.bincount(owner, weights=np.where(self.n_cx > 0, term, 0), minlength=size)
        self.keep = (self.keys % m > 0) & (self.n_c > 0) & (self.n_c >= min_count) & (g >= threshold)

    def find(self, up: np.ndarray, word: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``at`` and ``pair`` of other n-grams, all of which are known."""
        at = np.searchsorted(self.keys, up * self.m + word)
        return at, np.searchsorted(self.pairs, at * self.m + x)

    def deepen(self, p: np.ndarray, at: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """The probability of n-grams, given that by their shorter contexts."""
        kept = np.flatnonzero(self.keep[at])
        at, n_cx, p = at[kept], self.n_cx[pair[kept]], p.copy()
        p[kept] = (n_cx + self.u_c[at] * p[kept]) / (self.n_c[at] + self.u_c[at])
        return p


class Subtree:
    """The contexts that end in some words, in one piece, or in several if those of one word are too many.

    ``pieces`` read events, as often as asked: the ids of the words before, of
    the token and the place of its document, and the documents. ``c`` has the
    training count of every id.
    """

    def __init__(self, pieces: list[Callable], c: np.ndarray, n: int, v: int, depth: int, min_count: int,
                 threshold: float):
        self.pieces, self.depth, self.n = pieces, depth, n
        self.c, self.p = c, (c + 0.5) / (n + 0.5 * (v + 1))
        self.log = np.log10(self.p)
        self.level = partial(Level, m=len(c), min_count=min_count, threshold=threshold)
        self.top = None
        if len(pieces) > 1:
            tally = Tally(2)
            for read in pieces:
                for ids, docs in read():
                    tally.add(ids[0], ids[depth], (docs & 1)[ids[-1]])
            self.top = self.root(*tally.gathered())

    def root(self, h1: np.ndarray, x: np.ndarray, n: np.ndarray) -> Level:
        return self.level(np.zeros(len(x), np.int64), h1, x, n, np.full(len(x), float(self.n)), self.c[x])

    def learn(self, read: Callable) -> tuple[list[Level], np.ndarray, bool]:
        """Contexts of every length in a piece, with the suffixes of kept ones kept; probabilities of its n-grams.

        The last says whether equal events were merged, so that n-grams are not the events in their order.
        """
        tally = Tally(self.depth + 1)
        for ids, docs in read():
            tally.add(*ids[:-1], (docs & 1)[ids[-1]])
        *h, x, n = tally.gathered()
        top = self.top or self.root(h[0], x, n)
        levels = [top]
        at, pair = (top.at, top.pair) if top is not self.top else top.find(np.zeros(len(x), np.int64), h[0], x)
        places = [(at, pair)]
        for word in h[1:]:
            up = levels[-1]
            levels.append(self.level(at.astype(np.int64), word, x, n, up.n_c[at], up.n_cx[pair]))
            at, pair = levels[-1].at, levels[-1].pair
            places.append((at, pair))
        for longer, shorter in zip(levels[:0:-1], levels[-2::-1]):
            shorter.keep[longer.keys[longer.keep] // longer.m] = True
        p = self.p[x]
        for level, place in zip(levels, places):
            p = level.deepen(p, *place)
        return levels, p, tally.merged

    def scores(self) -> Iterator[tuple[np.ndarray, ...]]:
        """By block, rows with their tokens, known tokens and log10 probabilities by the base and by the tree, summed."""
        for read in self.pieces if self.top else []:
            self.learn(read)        # all pieces before any is scored: each may keep the context of one word
        for read in self.pieces:
            levels, p_of, merged = self.learn(read)
            done = 0
            for ids, docs in read():
                x, doc, size = ids[self.depth], ids[-1], len(docs)
                if merged:
                    p, at = self.p[x], np.zeros(len(x), np.int64)
                    for level, word in zip(levels, ids):
                        at, pair = level.find(at, word, x)
                        p = level.deepen(p, at, pair)
                else:
                    p = p_of[done:done + len(x)]
                    done += len(x)
                sums = (np.bincount(doc, minlength=size), np.bincount(doc[self.c[x] > 0], minlength=size),
                        np.bincount(doc, weights=self.log[x], minlength=size),
                        np.bincount(doc, weights=np.log10(p), minlength=size))
                here = np.flatnonzero(sums[0])
                yield (docs[here] >> 1, *[s[here] for s in sums])


def score_bucket(rows: Iterator[pa.RecordBatch], light: int, n: int, v: int, **model: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Learn and score one bucket, part by part; its blocks are spooled, since they are read more than once."""
    names, known, counts, blocks, spools = [np.zeros(1, np.uint64)], [], [], [], {}    # name 0: the place before a text
    with ExitStack() as files:
        for row in rows:
            own, docs, parts, ids = (row.column(c)[0].as_py() for c in ("names", "docs", "parts", "ids"))
            if docs is None:
                known.append(unpack(own, np.uint64))
                counts.append(unpack(ids[0], np.int64))
                continue
            for part, frame in zip(parts, ids):
                if part not in spools:
                    spools[part] = files.enter_context(SpooledTemporaryFile(SPOOL // 64))
                pickle.dump((len(blocks), frame), spools[part])
            blocks.append([own, docs])
            names.append(unpack(own, np.uint64))
            if sum(map(len, names)) > max(PENDING, 2 * len(names[0])):
                names = [np.unique(np.concatenate(names))]
        names = np.unique(np.concatenate(names))
        c = np.zeros(len(names))
        if known:
            c[np.searchsorted(names, np.concatenate(known))] = np.concatenate(counts)
        for block in blocks:
            block[0] = np.searchsorted(names, unpack(block[0], np.uint64)).astype(np.int32)

        def read(spool: SpooledTemporaryFile) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
            end = spool.seek(0, 2)
            spool.seek(0)
            while spool.tell() < end:
                i, frame = pickle.load(spool)
                place, docs = blocks[i]
                ids = unpack(frame, np.uint32).reshape(model["depth"] + 2, -1)
                yield [*place[ids[:-1]], ids[-1].astype(np.int32)], np.cumsum(unpack(docs, np.int64))

        pieces = [partial(read, spool) for part, spool in spools.items() if part >= light]
        for tree in [*[[partial(read, spool)] for part, spool in spools.items() if part < light], *([pieces] if pieces else [])]:
            yield from Subtree(tree, c, n, v, **model).scores()


def score_buckets(batches: Iterator[pa.RecordBatch], **model: float) -> Iterator[pa.RecordBatch]:
    """Rows with sums of the buckets of a partition, sorted by bucket; a row may come more than once."""
    def out(sums: Tally) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a) for a in sums.summed()],
                                          names=["_row", "n_tokens", "n_known", "base_score", "score"])

    rows = (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows))
    for _, blocks in groupby(rows, lambda row: row.column("bucket")[0].as_py()):
        sums = Tally(1)
        for found in score_bucket(blocks, **model):
            sums.add(*found)
        if sums.parts:
            yield out(sums)


def suffix_lm(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folds: int = 5, held: int = 1,
              depth: int = 2, min_count: int = 3, threshold: float = 8.0) -> DataFrame:
    """Score every row's text by a suffix tree learned from the rows outside the held-out fold.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``: ``held_out`` when crc32(id as text) mod ``folds`` is ``held``
    (a NULL id counts as held out and is not learned from). NULL text is
    empty and has one token, the end; repeated rows are scored one by one.
    Without training rows N = V = 0 and every token has probability 0.5 / 0.5
    = 1. Other columns are ignored; an empty table gives an empty one.

    ``base_score`` sums ``log10((c + 0.5) / (N + 0.5 (V + 1)))`` over the tokens
    (c the token's training count, N all, V distinct training tokens). A
    context c of up to ``depth`` words and n(c) >= ``min_count`` occurrences
    passes when ``2 * sum_x n(c,x) ln(p(x|c) / p(x|parent))`` (the G statistic
    of its next-token counts against its parent's, both maximum likelihood)
    reaches ``threshold``; passing contexts and all their suffixes are kept,
    so that they form a suffix tree. ``score`` takes for each token the
    longest kept context s_k before it and ``P(x|s_j) = (n(s_j,x) + u(s_j)
    P(x|s_{j-1})) / (n(s_j) + u(s_j))`` (Witten-Bell), from the base up to k.

    The tree is cut at its root: all contexts that end in one word lie in one
    bucket, which learns and scores them. A token moves once, packed, to the
    bucket of the word before it; only the counts of its words come from
    elsewhere, and only sums per row go on. A bucket holds its distinct
    n-grams; contexts of a heavy word are gone through in parts.

    Words are named by 64-bit hashes under a salt that gives no two words of
    the table one name, so counts are exact. Rows are numbered by
    ``monotonically_increasing_id`` over the scan, which a re-run after a
    lost executor numbers alike.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    held_out = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == held, F.lit(True))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"),
                       F.col(text).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    texts = rows.select("_row", "held_out", "_text")
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    buckets = min(1 << 16, max(2 * spark.sparkContext.defaultParallelism, 1 + size // BUCKET))
    light = 1 + size // buckets // PART
    salt, clash = -1, True
    while clash:        # with 64 bits two words of one name, and so a second pass, are rare
        salt += 1
        words = map_arrow(texts, partial(count_words, buckets=buckets, salt=salt), WORDS)
        counted = stage(map_arrow(words.repartition("name").sortWithinPartitions("name"), add_words, COUNTED))
        totals = counted.filter("bucket IS NULL")
        n, v, clash = totals.agg(F.sum("n"), F.sum("v"), F.max("clash")).first()
    n, v = n or 0, v or 0
    # at most n / HEAVY words; with one context word there is nothing to deal them by, nor more than one row a token
    heavy = [w for r in totals.filter(F.size("heavy") > 0).select("heavy").collect() for w in r.heavy] if depth > 1 else []
    dealt = 1 + n // (16 * HEAVY) if heavy else 0
    events = map_arrow(texts, partial(cut_events, depth=depth, buckets=buckets, salt=salt, light=light, heavy=heavy,
                                      dealt=dealt), BLOCKS)
    blocks = counted.filter("bucket IS NOT NULL").select(*events.columns).unionByName(events)
    placed = blocks.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    found = map_arrow(placed, partial(score_buckets, light=light, n=n, v=v, depth=depth, min_count=min_count,
                                      threshold=threshold), SUMS)
    scored = found.groupBy("_row").agg(*[F.sum(c).alias(c) for c in found.columns[1:]])
    return rows.select("_row", "doc_id", "held_out").join(scored, "_row").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
