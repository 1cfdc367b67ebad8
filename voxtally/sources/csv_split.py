"""CSV files with line breaks inside quotes, read in parallel blocks.

A file is split at line ends wherever Spark's scan splits it; a task takes
many blocks when they are small. Whether a line end closes a record depends
only on the parity of the quotes before it, so:

1. each block counts its quotes line by line (one pass, nothing but a few
   numbers a block leaves the task);
2. a running sum over the blocks of each file gives the parity at the start
   of every block, and with it the record that is still open there;
3. each block then cuts its lines into records by itself. Only the pieces of
   records that cross a block's end are shuffled to be joined; all other
   records are parsed where they were read.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage

CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
BLOCKS_BROADCAST = 1_000_000      # rows of the block table sent whole to every task; beyond, it is joined
TASKS_PER_CORE = 4                # at least so many tasks a core where blocks are packed


@contextmanager
def blocks_of(spark: SparkSession, block_bytes: int | None) -> Iterator[None]:
    """Scans run inside split files into blocks of ``block_bytes``; the session's setting is restored after."""
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name, None)
    if block_bytes:
        spark.conf.set(name, str(block_bytes))
    try:
        yield
    finally:
        if block_bytes:
            spark.conf.set(name, old) if old is not None else spark.conf.unset(name)


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    scan = spark.read.option("lineSep", "\n").text(paths)
    return scan.select("value", F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("ord"))


def _packed(lines: DataFrame, block_bytes: int | None, split_bytes: int) -> DataFrame:
    """Small blocks dealt whole to a few tasks a core, or one per ``split_bytes`` (a plain scan's tasks) if that is more.

    A task for each block would cost far more than reading it.
    """
    if not block_bytes or block_bytes >= split_bytes:
        return lines
    blocks = lines.rdd.getNumPartitions()
    cores = lines.sparkSession.sparkContext.defaultParallelism
    return lines.coalesce(max(1, min(blocks, max(TASKS_PER_CORE * cores, -(-blocks * block_bytes // split_bytes)))))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray, pa.RecordBatch, int]]:
    """Per batch and block: file, block, ords, the quote parity before each line within its block, the rows, the parity after.

    A task reads its blocks line by line in order, so the running parity of a
    block carries over from batch to batch.
    """
    current, parity = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        files = pc.dictionary_encode(batch.column("file")).indices.to_numpy(zero_copy_only=False)
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        quotes = pc.count_substring(batch.column("value").fill_null(""), '"').to_numpy(zero_copy_only=False) & 1
        changes = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        cuts = [0, *changes.tolist(), batch.num_rows]
        ords = batch.column("ord").to_numpy()
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = (batch.column("file")[a].as_py(), int(blocks[a]))
            if key != current:
                current, parity = key, 0
            before = (np.concatenate([[0], np.cumsum(quotes[a:b])[:-1]]) + parity) & 1
            parity = int((parity + quotes[a:b].sum()) & 1)
            yield key[0], key[1], ords[a:b], before, batch.slice(a, b - a), parity


def _block_summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a block: its quote parity and, for either parity at its start, the last line that would start a record."""
    found: dict[tuple[str, int], list] = {}
    for file, block, ords, before, _, parity in _runs(batches):
        got = found.setdefault((file, block), [0, None, None])
        got[0] = parity
        for b in (0, 1):
            starts = ords[before == b]
            if len(starts):
                got[1 + b] = int(starts[-1])
    keys = list(found)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
         pa.array([found[k][0] for k in keys], pa.int32()), pa.array([found[k][1] for k in keys], pa.int64()),
         pa.array([found[k][2] for k in keys], pa.int64())],
        ["file", "block", "parity", "last0", "last1"])


def _blocks(lines: DataFrame) -> DataFrame:
    """Per block: ``entry`` (quote parity at its start), ``exit`` and the record open at its start (``carry_*``)."""
    summary = lines.mapInArrow(_block_summary, "file string, block long, parity int, last0 long, last1 long")
    summary = summary.groupBy("file", "block").agg(*[F.max(c).alias(c) for c in ("parity", "last0", "last1")])
    # one row a block: a file's blocks are few beside its lines
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    entry = F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2
    with_entry = summary.withColumn("entry", entry.cast("int"))
    last = F.when(F.col("entry") == 0, F.col("last0")).otherwise(F.col("last1"))
    opened = F.when(last.isNotNull(), F.struct(F.col("block").alias("b"), last.alias("o")))
    marked = with_entry.withColumn("_open", opened)
    carried = marked.withColumn("_upto", F.last("_open", ignorenulls=True).over(upto)) \
        .withColumn("_carry", F.lag("_upto").over(Window.partitionBy("file").orderBy("block")))
    return carried.select("file", "block", "entry", ((F.col("entry") + F.col("parity")) % 2).alias("exit"),
                          F.col("_carry.b").alias("carry_block"), F.col("_carry.o").alias("carry_ord"),
                          (F.col("block") == F.min("block").over(Window.partitionBy("file"))).alias("first_block"))


PIECE = "file string, key_block long, key_ord long, part long, kind string, is_header boolean, record string"


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records cut inside each block: ``whole`` ones, the ``head`` of one that goes on, the ``tail`` of one carried in.

    The first record of a file's first block is marked as its header. A
    block's lines are gathered (a block is the unit read, bounded by the block
    size) and cut at once: line starts from the parities, records joined by
    Arrow.
    """
    gathered: list = []
    for run in _runs(batches):
        if gathered and (run[0], run[1]) != (gathered[0][0], gathered[0][1]):
            yield _cut_block(gathered)
            gathered = []
        gathered.append(run)
    if gathered:
        yield _cut_block(gathered)


def _cut_block(runs: list) -> pa.RecordBatch:
    file, block = runs[0][0], runs[0][1]
    first = runs[0][4]
    entry, exit_parity = first.column("entry")[0].as_py(), first.column("exit")[0].as_py()
    carry = (first.column("carry_block")[0].as_py(), first.column("carry_ord")[0].as_py())
    header = first.column("first_block")[0].as_py()
    values = pa.concat_arrays([r[4].column("value").fill_null("") for r in runs])
    ords = np.concatenate([r[2] for r in runs])
    before = np.concatenate([r[3] for r in runs])
    starts = np.flatnonzero(before == entry)
    n = len(ords)
    head_end = int(starts[0]) if len(starts) else n
    pieces = {"key_block": [], "key_ord": [], "kind": [], "is_header": []}
    texts = []
    if head_end:      # lines before the first start end a record carried in
        tail = pa.ListArray.from_arrays(pa.array([0, head_end], pa.int32()), values.slice(0, head_end))
        texts.append(pc.binary_join(tail, "\n"))
        pieces["key_block"].append(carry[0])
        pieces["key_ord"].append(carry[1])
        pieces["kind"].append("tail")
        pieces["is_header"].append(False)
    if len(starts):
        offsets = np.append(starts, n) - starts[0]
        records = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values.slice(int(starts[0])))
        texts.append(pc.binary_join(records, "\n"))
        k = len(starts)
        pieces["key_block"] += [block] * k
        pieces["key_ord"] += ords[starts].tolist()
        pieces["kind"] += ["whole"] * (k - 1) + ["head" if exit_parity else "whole"]
        pieces["is_header"] += [bool(header)] + [False] * (k - 1)
    count = len(pieces["kind"])
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * count, pa.string()), pa.array(pieces["key_block"], pa.int64()),
         pa.array(pieces["key_ord"], pa.int64()), pa.array([block] * count, pa.int64()),
         pa.array(pieces["kind"], pa.string()), pa.array(pieces["is_header"], pa.bool_()),
         pa.concat_arrays(texts).cast(pa.string()) if texts else pa.array([], pa.string())],
        ["file", "key_block", "key_ord", "part", "kind", "is_header", "record"])


def csv_records(spark: SparkSession, paths: list[str], block_bytes: int | None = None) -> DataFrame:
    """Every record of the CSV files as one string, with ``file``, ``key_block`` and ``key_ord`` (its first line)
    and ``is_header`` (the first record of a file).

    Quotes are ``"`` and a doubled quote stands for one; a line break inside
    quotes belongs to the field. ``block_bytes`` sets the size of the blocks
    read by one task (Spark's default otherwise). Lines are split at ``\\n``
    only, so a ``\\r`` stays in its field. A quote left open at the end of a
    file makes the rest of the file one record, as in a whole-file read, but without the file's last line break.
    """
    lines = _lines(spark, paths)
    split_bytes = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    # both passes over the lines run here, so that they see the same blocks
    with blocks_of(spark, block_bytes):
        lines = _packed(lines, block_bytes, split_bytes)
        blocks = stage(_blocks(lines))
        small = blocks.limit(BLOCKS_BROADCAST + 1).count() <= BLOCKS_BROADCAST
        if small:
            # a broadcast join keeps the scan's order of lines within each task
            joined = lines.join(F.broadcast(blocks), ["file", "block"])
        else:
            joined = lines.join(blocks, ["file", "block"]).repartition("file", "block") \
                .sortWithinPartitions("file", "block", "ord")
        pieces = stage(joined.select("value", "file", "block", "ord", "entry", "exit", "carry_block", "carry_ord",
                                     "first_block").mapInArrow(_assemble, PIECE), "kind")
    whole = pieces.filter(F.col("kind") == "whole").select("file", "key_block", "key_ord", "is_header", "record")
    # only records that cross a block's end: at most two pieces a block
    joined_up = pieces.filter(F.col("kind") != "whole").groupBy("file", "key_block", "key_ord").agg(
        F.max("is_header").alias("is_header"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "record"))), lambda s: s["record"]),
                     "\n").alias("record"))
    return whole.unionByName(joined_up)


def read_csv_split(spark: SparkSession, paths: list[str], columns: list[str], header: bool = True,
                   block_bytes: int | None = None) -> DataFrame:
    """The rows of CSV files as text columns ``columns``, then ``source_file``, ``record_block`` and
    ``record_ord`` (the block and line where the record starts: in file order); blank lines are skipped.

    With ``header`` the first record of each file is its header and is left out.
    Fields are parsed with the options of a whole-file read, so that both
    give the same rows.
    """
    records = csv_records(spark, paths, block_bytes).filter(F.col("record") != "")
    if header:
        records = records.filter(~F.col("is_header"))
    schema = ", ".join(f"`{c}` string" for c in columns)
    parsed = records.select(F.from_csv("record", schema, CSV_OPTIONS).alias("r"), F.col("file").alias("source_file"),
                            F.col("key_block").alias("record_block"), F.col("key_ord").alias("record_ord"))
    return parsed.select("r.*", "source_file", "record_block", "record_ord")
