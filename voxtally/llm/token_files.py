"""Token ids of a corpus as files of range-coded blocks, and the way back."""

from __future__ import annotations

import json
import os
import string
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir, small_table
from .hashing import text_bytes
from .range_coder import decode_block, encode_block
from .text import bound_batches, map_arrow

BLOCK = 1 << 20                    # ids of a block at least, except for a part's last
BATCH = 1 << 22                    # bytes of text that are encoded at once, or one longer text
CACHE = 400_000                    # words whose ids a Python worker remembers
JOINED = 100                       # words that are handed over as one text

OTHER, SPACE, CONTROL, LETTER, STOP, HIGH = range(6)
_KINDS = np.full(256, OTHER, np.uint8)
_KINDS[[0x20, *range(0x09, 0x0E)]] = SPACE
_KINDS[0x1C:0x20] = CONTROL                                # white space to some
_KINDS[np.frombuffer(string.ascii_letters.encode(), np.uint8)] = LETTER
_KINDS[np.frombuffer(b".,;:!?", np.uint8)] = STOP
_KINDS[0x80:] = HIGH


def _after_wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place, not an ASCII one, is white space."""
    a, b, c = data[at - 1], data[at - 2], data[at - 3]
    return ((b == 0xC2) & ((a == 0x85) | (a == 0xA0))
            | (c == 0xE2) & (b == 0x80) & ((a <= 0x8B) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))
            | (c == 0xE2) & (b == 0x81) & (a == 0x9F) | (c == 0xE3) & (b == 0x80) & (a == 0x80)
            | (c == 0xE1) & ((b == 0x9A) & (a == 0x80) | (b == 0xA0) & (a == 0x8E)))


def word_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places at which the byte-level pattern cuts whatever stands around them.

    These are the starts of texts and of runs of white space, an ASCII stop
    after an ASCII letter, and what follows a single white space other than a
    space. A run of white space is never parted from what follows it
    otherwise, since the pattern looks ahead there.
    """
    if not len(data):
        return np.empty(0, np.int64)
    starts = bounds[:-1][bounds[1:] > bounds[:-1]]
    kind = _KINDS[data]
    before = np.empty_like(kind)
    before[1:] = kind[:-1]
    before[starts] = OTHER
    run = (kind == SPACE) & (before != SPACE) & (before != CONTROL)
    wide = np.flatnonzero(run & (before == HIGH))
    run[wide[_after_wide_space(data, wide)]] = False
    cut = run | (kind == STOP) & (before == LETTER)
    cut[1:] |= run[:-1] & (data[:-1] != 0x20) & ((kind[1:] == OTHER) | (kind[1:] == LETTER) | (kind[1:] == STOP))
    cut[starts] = True
    return np.flatnonzero(cut)


class Runs:
    """Words and the ids of each, one after another."""

    def __init__(self, words: pa.Array, ids: np.ndarray, n: np.ndarray) -> None:
        self.words, self.ids, self.n = words, ids, n

    def of(self, at: np.ndarray) -> np.ndarray:
        """The ids of the words at these places."""
        n = self.n[at]
        shift = (np.cumsum(self.n) - self.n)[at] - (np.cumsum(n) - n)
        return self.ids[np.repeat(shift, n) + np.arange(n.sum())]

    def take(self, at: np.ndarray) -> Runs:
        return Runs(self.words.take(pa.array(at)), self.of(at), self.n[at])

    def plus(self, other: Runs) -> Runs:
        return Runs(pa.concat_arrays([self.words, other.words]), np.concatenate([self.ids, other.ids]),
                    np.concatenate([self.n, other.n]))


def _runs(words: pa.Array, coded: list[bytes]) -> Runs:
    return Runs(words, np.frombuffer(b"".join(coded), np.uint32), np.array([len(c) // 4 for c in coded], np.int64))


class Encoder:
    """Ids of whole texts by the tokenizers library.

    A tokenizer that cuts a text by the byte-level pattern before it merges
    bytes gives the same ids word by word (``word_starts``) as for the whole
    text. For those each distinct word of a batch is looked up among the last
    words of the Python worker, ``CACHE`` beside those of the batch, and only
    new ones are encoded; texts of other tokenizers are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(path)
        self.coder.encode_special_tokens = True             # their strings in a text are ordinary text
        plan = json.loads(self.coder.to_str())
        cut = plan["pre_tokenizer"] or {}
        self.by_word = (plan["normalizer"] is None and plan["post_processor"] is None
                        and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
                        and all(t["special"] for t in plan["added_tokens"]))
        vocabulary = self.coder.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)   # one character a byte
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.known = _runs(pa.array([], pa.large_string()), [])
        self.met = np.empty(0, np.int64)                    # the batch that last had each known word
        self.batch = 0

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.coder.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: pa.Array) -> Runs | None:
        """Ids of words each of which the pattern parts from any other before it."""
        data, bounds = text_bytes(words)
        edges = bounds[[*range(0, len(words), JOINED), len(words)]].tolist()
        raw = data.tobytes()
        coded = self.coder.encode_batch_fast([raw[a:b].decode() for a, b in zip(edges, edges[1:])],
                                             add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in coded])
        ends = np.concatenate([[0], np.cumsum(self.bytes_of[ids])])
        at = np.searchsorted(ends, bounds)
        if at[-1] != len(ids) or (ends[at] != bounds).any():
            return None                                     # bytes that the vocabulary cannot spell
        return Runs(words, ids, np.diff(at))

    def _encoded(self, words: pa.Array) -> Runs:
        """Ids of new words."""
        data, bounds = text_bytes(words)
        first, last = bounds[:-1], bounds[1:] - 1
        second = data[np.minimum(first + 1, last)]
        joint = (data[first] == 0x20) & (last > first) & ~np.isin(_KINDS[second], (SPACE, CONTROL)) \
            & ~np.isin(second, (0xC2, 0xE1, 0xE2, 0xE3)) & ~np.isin(_KINDS[data[last]], (SPACE, CONTROL))
        high = np.flatnonzero(joint & (data[last] >= 0x80))
        joint[high[_after_wide_space(data, last[high] + 1)]] = False
        found = self._joined(words.filter(pa.array(joint))) if joint.any() else None
        if found is None:
            return _runs(words, self._raw(words.to_pylist()))
        rest = words.filter(pa.array(~joint))
        order = np.argsort(np.argsort(~joint, kind="stable"), kind="stable")
        return found.plus(_runs(rest, self._raw(rest.to_pylist()))).take(order)

    def _look_up(self, words: pa.Array) -> np.ndarray:
        """Places of distinct words among the known ones, after new ones were added."""
        found = pc.index_in(words, value_set=self.known.words)
        is_new = found.is_null().to_numpy(zero_copy_only=False)
        new = words.filter(pa.array(is_new))
        at = found.fill_null(0).to_numpy().astype(np.int64)
        self.met[at[~is_new]] = self.batch
        if len(self.known.n) + len(new) > CACHE + len(words):
            # the words of this batch stay, then those met last
            kept = np.sort(np.argsort(-self.met, kind="stable")[:max(CACHE // 2, len(words) - len(new))])
            self.known, self.met = self.known.take(kept), self.met[kept]
            at = np.searchsorted(kept, at)
        if len(new):
            at[is_new] = len(self.known.n) + np.arange(len(new))
            self.known = self.known.plus(self._encoded(new))
            self.met = np.append(self.met, np.full(len(new), self.batch))
        self.batch += 1
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has; NULL is empty."""
        if not self.by_word:
            coded = _runs(texts, self._raw(texts.fill_null("").to_pylist()))
            return coded.ids, coded.n
        data, bounds = text_bytes(texts)
        starts = word_starts(data, bounds)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        words = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)).dictionary_encode()
        at = self._look_up(words.dictionary)[words.indices.to_numpy()]
        upto = np.concatenate([[0], np.cumsum(self.known.n[at])])
        return self.known.of(at), np.diff(upto[np.searchsorted(starts, bounds)])

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers."""
        ids, n = self.encode(pa.array(texts, pa.large_string()))
        raw, ends = ids.tobytes(), np.cumsum(4 * n).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of this Python worker; the tasks it runs share the words they met."""
    return Encoder(path)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts in portions of about ``BATCH`` bytes, whole texts."""
    held, size = [], 0
    for batch in batches:
        bytes_ = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first, done = 0, 0
        while first < len(batch):
            stop = min(len(batch), int(np.searchsorted(bytes_, done + BATCH - size)) + 1)
            held.append(batch.slice(first, stop - first))
            first, size, done = stop, size + int(bytes_[stop - 1]) - done, int(bytes_[stop - 1])
            if size >= BATCH:
                yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))
                held, size = [], 0
    if held:
        yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in (0, 1))


def token_lengths(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` of every row: the ids of its whole text, without an end id; NULL text has 0.

    Texts are encoded where they are read; only ids and lengths leave Python.
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("n_tokens", T.LongType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for ids, texts in _texts(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(coder.encode(texts)[1])], schema.names)

    return map_arrow(source, measure, schema)


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 0,
                 doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text and write the ids in ascending order of id.

    ``folder`` gets a Parquet table of blocks: ``part, block, before, docs,
    sizes, payload``. Parts follow each other in order of id, blocks within a
    part by ``block``; ``before`` counts the part's ids in earlier blocks,
    ``docs`` and ``sizes`` name the documents of the block and their ids each,
    ``payload`` is one range-coded block. Blocks hold whole documents and are
    independent of each other. ``end_id`` is appended to each document; a NULL
    text is empty. A NULL document id comes last; rows with one id follow each
    other in the order of their texts.
    """
    bound_batches(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = source.repartitionByRange(parts, order[0]).sortWithinPartitions(*order)
    kind = source.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("before", T.LongType()), T.StructField("docs", T.ArrayType(kind)),
        T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(path), TaskContext.get().partitionId()
        block, before, held = 0, 0, 0
        docs_: list[pa.Scalar] = []
        runs: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            names = pa.array([d.as_py() for d in docs_], docs_[0].type)
            row = [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([before], pa.int64()),
                   pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                   pa.array([[len(r) for r in runs]], pa.list_(pa.int64())),
                   pa.array([encode_block(np.concatenate(runs))], pa.binary())]
            return pa.RecordBatch.from_arrays(row, schema.names)

        for ids, texts in _texts(batches):
            coded, sizes = coder.encode(texts)
            for doc, run in zip(ids, np.split(coded, np.cumsum(sizes)[:-1])):
                docs_.append(doc)
                runs.append(np.append(run, np.uint32(end_id)))
                held += len(runs[-1])
                if held >= BLOCK:
                    yield close()
                    block, before, held, docs_, runs = block + 1, before + held, 0, [], []
        if docs_:
            yield close()

    map_arrow(ranged, encode, schema).write.parquet(folder)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, and ``ids`` on request.

    Blocks are decoded and checked on their own, each in one task. ``start``
    counts the ids of all documents before; ``ids_crc32`` is that of the
    document's ids as little-endian unsigned 32-bit integers.
    """
    blocks = spark.read.parquet(folder)
    kind = blocks.schema["docs"].dataType.elementType
    fields = [T.StructField("doc_id", kind), T.StructField("part", T.IntegerType()),
              T.StructField("at", T.LongType()), T.StructField("n_tokens", T.LongType()),
              T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(len(big)):
                part, before = big.column("part")[i].as_py(), big.column("before")[i].as_py()
                sizes = big.column("sizes")[i].values.to_numpy()
                ids = decode_block(big.column("payload")[i].as_py())
                if sizes.sum() != len(ids):
                    raise ValueError("damaged block")
                stops = np.cumsum(sizes)
                raw = ids.astype("<u4")
                sums = [zlib.crc32(raw[b - n:b].tobytes()) for b, n in zip(stops.tolist(), sizes.tolist())]
                columns = [big.column("docs")[i].values, pa.array(np.full(len(sizes), part, np.int32)),
                           pa.array(before + stops - sizes), pa.array(sizes), pa.array(sums, pa.int64())]
                if with_ids:
                    offsets = np.concatenate([[0], stops]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(raw.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    # one row per part: bounded by the number of partitions written
    totals = (blocks.select("part", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n).alias("n"))
              .groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts, total = [], 0
    for r in sorted(totals):
        starts.append((r["part"], total))
        total += r["n"]
    first = small_table(spark, starts, part=pa.int32(), first=pa.int64())
    found = map_arrow(blocks, decode, schema).join(first, "part")
    return found.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
                        *["ids"] * with_ids)


def token_files(docs: DataFrame, path: str, end_id: int = 0, folder: str | None = None,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all texts (``write_tokens``) and read them back (``read_tokens``).

    Without a ``folder`` the files go to the shared scratch folder. One row per
    input row; an empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    write_tokens(docs, folder, path, end_id, doc_id, text)
    return read_tokens(spark, folder)
