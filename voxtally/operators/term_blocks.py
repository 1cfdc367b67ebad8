"""Terms of texts in packed blocks, so that term counts, not postings, are moved.

The words of some thousand documents make a block, one compressed row. Document
frequencies are counted from the distinct terms of each block, which go to the
bucket that their words name; the bucket answers with the frequency of each, in
the same order, and no term travels back. A block's terms are found again from
its words, so the answer needs no names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..llm.suffix_lm import pack, unpack
from ..llm.text import map_arrow, release_memory

BLOCK_BYTES = 10 << 20    # bytes of words in a block, at most about (a longer text is a block of its own)
BUCKET_BYTES = 8 << 20   # bytes of words whose terms make a bucket, about
SHARES = 8                # buckets over which the two-word terms of one first word are dealt
ROWS = 1 << 18            # result rows handed over at a time
BINS = 16                 # bins of the histogram of document frequencies per factor of 2

SPACE, LINE = (pa.scalar(x, pa.large_string()) for x in (" ", "\n"))
ASKED = "bucket int, block long, terms binary, counts binary"
ANSWERED = "block long, bucket int, dfs binary"


def word_blocks(df: DataFrame, key: str, spaced: Column) -> DataFrame:
    """``(block, keys, bytes, text)``: space-separated words of many documents in one row.

    A document without words keeps its key and its place.
    """
    source = df.select(F.col(key).alias("key"), spaced.alias("text"))
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(source.schema["key"].dataType)),
        T.StructField("bytes", T.LongType()), T.StructField("text", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        coder = zstandard.ZstdCompressor(level=3)
        keys, texts, size = [], [], 0

        def block() -> pa.RecordBatch:
            rows = pa.concat_arrays(keys)
            return pa.RecordBatch.from_arrays([
                pa.array([first + made], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
                pa.array([size], pa.int64()), pa.array([coder.compress("\n".join(texts).encode())], pa.binary())],
                ["block", "keys", "bytes", "text"])

        for batch in batches:
            begin, column = 0, batch.column(1).fill_null("")
            lengths = pc.binary_length(column).to_numpy(zero_copy_only=False)
            for end, length in enumerate(lengths.tolist()):
                if texts or end > begin:
                    if size + length > BLOCK_BYTES:
                        keys.append(batch.column(0).slice(begin, end - begin))
                        texts += column.slice(begin, end - begin).to_pylist()
                        yield block()
                        made, begin, keys, texts, size = made + 1, end, [], [], 0
                size += length
            keys.append(batch.column(0).slice(begin))
            texts += column.slice(begin).to_pylist()
        if texts:
            yield block()

    return map_arrow(source, work, schema)


class Terms:
    """Distinct one- and two-word terms of a block, by bucket, and the documents that hold them.

    ``first`` and ``second`` are places in ``words``, whose first is the empty
    word: the second of a one-word term. ``doc``, ``term`` and ``tf`` are the
    postings, ordered by term, then by document.
    """

    def __init__(self, text: bytes, buckets: int):
        texts = pa.array(zstandard.ZstdDecompressor().decompress(text).decode().split("\n"), pa.large_string())
        self.docs = len(texts)
        held = np.flatnonzero(pc.not_equal(texts, "").to_numpy(zero_copy_only=False))
        lists = pc.split_pattern(texts.take(pa.array(held)), " ")
        doc = np.repeat(held, lists.value_lengths().to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        del texts, lists
        names, ids = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        del coded
        order = pc.sort_indices(names)   # neighbours alike compress well
        place = np.empty(len(names), np.int64)
        place[order.to_numpy()] = np.arange(1, len(names) + 1)
        self.words = pa.concat_arrays([pa.array([""], names.type), names.take(order)])
        ids, width = place[ids], len(self.words)
        pairs = np.flatnonzero(doc[:-1] == doc[1:])
        codes, at = np.unique(np.concatenate([ids * width, ids[pairs] * width + ids[pairs + 1]]), return_inverse=True)
        docs = np.concatenate([doc, doc[pairs]])
        del ids, doc, pairs
        first, second = codes // width, codes % width
        hashes = word_hashes(self.words)
        self.bucket = ((hashes[first] + np.where(second > 0, hashes[second] % np.uint64(SHARES), np.uint64(0)))
                       % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(self.bucket, kind="stable")
        self.first, self.second, self.bucket = first[order], second[order], self.bucket[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        del codes, order, first, second
        docs += place[at] * self.docs
        del at
        postings, self.tf = np.unique(docs, return_counts=True)
        del docs
        self.term, self.doc = postings // self.docs, postings % self.docs

    def spelled(self, which: np.ndarray) -> pa.Array:
        """The terms at these places."""
        first, second = self.words.take(pa.array(self.first[which])), self.words.take(pa.array(self.second[which]))
        return pc.if_else(pc.equal(second, ""), first, pc.binary_join_element_wise(first, second, SPACE)).cast(pa.string())

    def asked(self) -> Iterator[tuple[int, bytes, bytes]]:
        """Per bucket its terms, a line for each first word with its second words, and how many documents hold each."""
        counts, coder = np.bincount(self.term, minlength=len(self.first)), zstandard.ZstdCompressor(level=3)
        for a, b in equal_runs(self.bucket):
            begins = np.append(0, np.flatnonzero(np.diff(self.first[a:b])) + 1)
            places = np.insert(self.second[a:b], begins, self.first[a:b][begins])
            lines = pa.ListArray.from_arrays(
                pa.array(np.append(begins + np.arange(len(begins)), len(places)), pa.int32()), self.words.take(pa.array(places)))
            lines = pc.binary_join(lines, SPACE)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), LINE)[0]
            yield int(self.bucket[a]), coder.compress(text.as_buffer()), pack(counts[a:b].astype(np.int32))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes, the same in every process."""
    return pd.util.hash_array(words.cast(pa.large_binary()).to_numpy(zero_copy_only=False), categorize=False)


def equal_runs(ordered: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of every run of equal numbers."""
    cuts = np.flatnonzero(np.diff(ordered)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(ordered)]) if len(ordered) else iter(())


def bucket_count(blocks: DataFrame) -> int:
    """Buckets of about BUCKET_BYTES of words, at least one per core."""
    size = blocks.agg(F.sum("bytes")).first()[0] or 0
    return max(blocks.sparkSession.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))


def document_frequencies(blocks: DataFrame, buckets: int, least: float, most: float) -> DataFrame:
    """``(block, bucket, dfs)``: for the terms of a block in a bucket, in the order
    of ``Terms``, the number of documents that hold them, 0 outside of the bounds.

    Rows with block -1 hold a histogram of a bucket's frequencies within the bounds.
    """
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(b, block, terms, counts) for b, terms, counts in Terms(text.as_py(), buckets).asked()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                        pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "block", "terms", "counts"])
                    del rows
                    release_memory()

    def answer(table: pa.Table) -> pa.Table:
        try:
            bucket, coder = table.column("bucket")[0].as_py(), zstandard.ZstdDecompressor()
            lines = [pc.split_pattern(pa.array(coder.decompress(x.as_py()).decode().split("\n"), pa.large_string()), " ")
                     for x in table.column("terms")]
            counts = [unpack(x.as_py(), np.int32) for x in table.column("counts")]
            lengths = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in lines]).astype(np.int64)
            coded = pa.concat_arrays([x.flatten() for x in lines]).dictionary_encode()
            del lines
            ids, width = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
            del coded
            begins = np.cumsum(lengths) - lengths
            codes = np.delete(np.repeat(ids[begins], lengths) * width + ids, begins)
            del ids, lengths, begins
            distinct, at = np.unique(codes, return_inverse=True)
            del codes
            df = np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)
            df[(df < least) | (df > most)] = 0
            ends = np.cumsum([len(c) for c in counts])
            dfs = [pack(d.astype(np.int32)) for d in np.split(df[at], ends[:-1])]
            dfs.append(pack(np.bincount(bin_of(df[df > 0]))))
            blocks = [*table.column("block").to_pylist(), -1]
            return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([bucket] * len(blocks), pa.int32()),
                             "dfs": pa.array(dfs, pa.binary())})
        finally:
            release_memory()

    return map_arrow(blocks.select("block", "text"), ask, ASKED).groupBy("bucket").applyInArrow(answer, ANSWERED)


def bin_of(df: np.ndarray) -> np.ndarray:
    return np.floor(BINS * np.log2(df)).astype(np.int64)


def frequency_histogram(answers: DataFrame) -> np.ndarray:
    """How many terms within the bounds have a document frequency in each bin."""
    found = [unpack(r["dfs"], np.int64) for r in answers.filter("block = -1").select("dfs").toLocalIterator()]
    out = np.zeros(max((len(x) for x in found), default=0), np.int64)
    for x in found:
        out[:len(x)] += x
    return out


def frequency_of_the_first(histogram: np.ndarray, terms: int) -> int:
    """A document frequency that at most about ``terms`` terms reach, or one bin of them."""
    reached = np.cumsum(histogram[::-1])[::-1]
    lowest = min(int(np.count_nonzero(reached > terms)), max(len(reached) - 1, 0))
    return int(np.ceil(2 ** (lowest / BINS)))


def weigh(blocks: DataFrame, buckets: int, n: int, schema: T.StructType, least: int | None = None) -> DataFrame:
    """``blocks`` with their answers in ``found`` and, where keys repeat, the squared
    norms of the documents' keys in ``norms``, read into one of three tables.

    With columns of a posting each posting and its ``_w`` = tf * idf; with
    ``score`` the sum of weights of each term in ``least`` documents or more;
    with ``own`` the squared norm of each document.
    """
    names = schema.fieldNames()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            for i in range(len(batch)):
                terms = Terms(batch.column("text")[i].as_py(), buckets)
                df = np.concatenate([unpack(x["dfs"].as_py(), np.int32) for x in batch.column("found")[i]])
                used = df[terms.term] > 0
                doc, term, tf = terms.doc[used], terms.term[used], terms.tf[used]
                w = tf * (np.log((1.0 + n) / (1.0 + np.maximum(df, 1))) + 1.0)[term]
                norm = np.bincount(doc, w * w, terms.docs).astype(np.float64)   # integers when empty
                if "norms" in batch.schema.names:
                    norm = batch.column("norms")[i].values.to_numpy(zero_copy_only=False)
                if "own" in names:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(terms.docs, batch.column("block")[i].as_py())), pa.array(np.arange(terms.docs)),
                        keys[i].values, pa.array(norm)], names)
                elif "score" in names:
                    sums = np.bincount(term, w / np.sqrt(norm)[doc], len(df)).astype(np.float64)
                    kept = np.flatnonzero((df > 0) & (df >= least))
                    yield pa.RecordBatch.from_arrays([
                        terms.spelled(kept), pa.array(df[kept].astype(np.int64)), pa.array(sums[kept])], names)
                else:
                    kept = np.flatnonzero(df > 0)
                    place = np.zeros(len(df), np.int64)
                    place[kept] = np.arange(len(kept))
                    spelled = terms.spelled(kept)
                    for a in range(0, len(doc), ROWS):
                        d, t = doc[a:a + ROWS], term[a:a + ROWS]
                        yield pa.RecordBatch.from_arrays([
                            keys[i].values.take(pa.array(d)), spelled.take(pa.array(place[t])),
                            pa.array(tf[a:a + ROWS].astype(np.int32)), pa.array(w[a:a + ROWS]), pa.array(norm[d])], names)
                del terms, df, used, doc, term, tf, w, norm
                release_memory()

    return map_arrow(blocks, work, schema)
