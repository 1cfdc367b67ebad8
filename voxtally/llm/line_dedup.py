"""Near-duplicate lines across a corpus, by a deletion-neighbourhood join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .hashing import _SPACES, U64, mix, pack_text, powers, text_bytes, unpack_text, word_hashes
from .text import SPACE, SPACED_WORD, bound_batches, map_arrow

NEWLINE = 0x0A
# Kinds of keys: exact line, first and last half for both kinds of edit, variants.
_KINDS = mix(np.arange(1, 9, dtype=U64))
# Least words of a line for one-word edits. A line of fewer is compared by characters
# from so many on: in documents of sf0.1 the pairs that joined at 12, 16 and 20 were copies
# but for a character.
EDIT_WORDS = 8
EDIT_CHARACTERS = 16


class Lines:
    """Lines of a text column that have a word, as runs of word hashes.

    ``doc`` and ``number`` place a line; ``first`` and ``size`` give its words,
    ``begin`` and ``units`` what edits are counted in: the words of a line of
    ``EDIT_WORDS`` or more, the characters of a shorter one of
    ``EDIT_CHARACTERS`` or more, nothing (0) of any other. With ``least`` only
    lines of so many words are there and their words are the units. A hash of
    any run of units comes from prefix sums, so halves and deletion variants
    cost the same whatever their length.
    """

    def __init__(self, column: pa.Array, least: int | None = None) -> None:
        data, bounds = text_bytes(column)
        ends = np.flatnonzero(data == NEWLINE)
        begins = np.unique(np.concatenate([bounds[:-1], ends + 1]))
        begins = begins[begins < len(data)]
        doc = np.searchsorted(bounds, begins, side="right") - 1
        # a line's number counts the line breaks before it in its own text
        number = np.searchsorted(ends, begins) - np.searchsorted(ends, bounds[doc])
        self.words, places = word_hashes(data, bounds, lower=False)
        first = np.searchsorted(places, begins)
        size = np.diff(np.concatenate([first, [len(places)]]))
        keep = size >= (1 if least is None else least)
        self.doc, self.number, self.first, self.size = doc[keep], number[keep], first[keep], size[keep]
        self.begin, self.units = self.first, self.size
        if least is None:
            self._count_characters(data, begins[keep], np.append(begins[1:], len(data))[keep])
        up, self.down = powers(len(self.words) + 1)
        self.up = up
        self.sums = np.concatenate([[U64(0)], np.cumsum(self.words * up[:len(self.words)], dtype=U64)])

    def _count_characters(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        """Characters that are not white space as units of the lines of few words."""
        short = np.flatnonzero(self.size < EDIT_WORDS)
        self.units = self.units.copy()
        self.units[short] = 0
        short = short[ends[short] - begins[short] >= EDIT_CHARACTERS]
        length = ends[short] - begins[short]
        line = np.repeat(np.arange(len(short)), length)
        at = np.arange(len(line)) - np.repeat(np.cumsum(length) - length - begins[short], length)
        starts = ((data[at] & 0xC0) != 0x80) & ~_SPACES[data[at]]
        count = np.bincount(line[starts], minlength=len(short))
        at = at[starts & (count >= EDIT_CHARACTERS)[line]]
        enough = count >= EDIT_CHARACTERS
        short, count = short[enough], count[enough]
        code, inside = data[at].astype(U64), np.ones(len(at), dtype=bool)
        for k in range(1, 4):
            more = data[np.minimum(at + k, len(data) - 1)]
            inside &= (at + k < len(data)) & ((more & 0xC0) == 0x80)
            code |= np.where(inside, more, 0).astype(U64) << U64(8 * k)
        self.begin = self.begin.copy()
        self.begin[short] = len(self.words) + np.cumsum(count) - count
        self.units[short] = count
        self.words = np.concatenate([self.words, mix(code + _KINDS[2])])

    def run(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Unfinished hash of units ``a..b``."""
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit names of every line."""
        raw = self.run(self.first, self.first + self.size)
        n = self.size.astype(U64)
        return mix(raw + n * _KINDS[0]), mix(raw * _KINDS[6] ^ mix(n + _KINDS[7]))

    def halves(self) -> np.ndarray:
        """Four keys per line with units, of which two lines within one edit share one.

        A substitution leaves the first or the last half of both lines as it
        is; a deletion does so for the halves of the shorter line's length.
        """
        own = self.units > 0
        first, n, keys = self.begin[own], self.units[own], []
        # a line of n units meets lines of n or more as the shorter one, shorter ones as the longer
        for shorter in (n, n - 1):
            half = shorter // 2
            for kind, (a, b) in enumerate(((first, first + half), (first + n - half, first + n))):
                tag = mix(shorter.astype(U64) * U64(2) + U64(kind) + _KINDS[1])
                keys.append(mix(self.run(a, b) + tag))
        return np.stack(keys, axis=1)

    def variants(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Line index, key and role of every entry of the deletion-neighbourhood join.

        Role 0: the line without its unit ``i``, together with ``i``; lines
        with one key differ in that unit only. Role 1: the line without a
        unit; role 2: the line itself; a 1 and a 2 with one key differ by one
        inserted unit. Lines without units have no entry. Bit ``k`` of ``shared`` tells that another line has the
        k-th of the line's ``halves``: an edit then lies outside that half.
        """
        line = np.repeat(np.arange(len(self.units)), self.units)
        i = np.arange(len(line)) - np.repeat(np.cumsum(self.units) - self.units, self.units)
        a, n, bits = self.begin[line], self.units[line], shared[line]
        raw = self.run(a, a + i) + self.run(a + i + 1, a + n) * self.up[i]
        shorter = (n - 1).astype(U64)
        alike = mix(raw + mix(shorter + _KINDS[3]) + mix(i.astype(U64) + _KINDS[4]))
        deleted = mix(raw + mix(shorter + _KINDS[5]))
        itself = np.flatnonzero(self.units)
        b, m = self.begin[itself], self.units[itself]
        own = mix(self.run(b, b + m) + mix(m.astype(U64) + _KINDS[5]))
        same, less = n // 2, (n - 1) // 2
        one = ((bits & 1 > 0) & (i >= same)) | ((bits & 2 > 0) & (i < n - same))
        two = ((bits & 4 > 0) & (i >= less)) | ((bits & 8 > 0) & (i < n - less))
        lines = np.concatenate([line[one], line[two], itself])
        roles = np.repeat(np.array([0, 1, 2], np.int32), [one.sum(), two.sum(), len(own)])
        return lines, np.concatenate([alike[one], deleted[two], own]), roles


def within_one_edit(one: Column, other: Column) -> Column:
    """Whether two arrays of units differ by one inserted, deleted or replaced unit at most.

    Their common prefix and suffix must cover all but one unit of the longer.
    """
    both = F.least(F.size(one), F.size(other))

    def prefix(a: Column, b: Column) -> Column:
        same = F.zip_with(F.slice(a, 1, both), F.slice(b, 1, both), lambda x, y: x == y)
        first = F.array_position(same, False).cast("int")
        return F.when(first > 0, first - 1).otherwise(both)

    longer = F.greatest(F.size(one), F.size(other))
    return ((F.abs(F.size(one) - F.size(other)) <= 1)
            & (prefix(one, other) + prefix(F.reverse(one), F.reverse(other)) >= longer - 1))


def _units(line: Column, least: int | None) -> Column:
    """What edits of a line are counted in, as in ``Lines``."""
    words = F.regexp_extract_all(line, F.lit(SPACED_WORD), F.lit(0))
    if least is not None:
        return words
    return F.when(F.size(words) < EDIT_WORDS, F.regexp_extract_all(line, F.lit(f"[^{SPACE}]"), F.lit(0))).otherwise(words)


def _line_names(docs: DataFrame, least: int | None) -> DataFrame:
    schema = docs.select("doc_id").schema
    for name, kind in (("number", "integer"), ("high", "long"), ("low", "long"),
                       ("k0", "long"), ("k1", "long"), ("k2", "long"), ("k3", "long")):
        schema = schema.add(name, kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, len(big), 1024):
                batch = big.slice(at, 1024)
                lines = Lines(batch.column(1), least)
                high, low = lines.whole()
                keys = np.zeros((len(high), 4), dtype=U64)
                keys[lines.units > 0] = lines.halves()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(lines.doc)), pa.array(lines.number.astype(np.int32)),
                     pa.array(high.view(np.int64)), pa.array(low.view(np.int64)),
                     # no unit, no key
                     *(pa.array(np.ascontiguousarray(keys[:, i]).view(np.int64), mask=lines.units == 0)
                       for i in range(4))], schema.names)

    return map_arrow(docs.select("doc_id", "text"), work, schema)


def _chosen_lines(column: pa.Array, numbers: pa.Array) -> tuple[list[int], list[int], list[int], list[str]]:
    """Of each text the lines with the listed numbers: row, number, shared halves, line."""
    rows, found, bits, lines = [], [], [], []
    for row, (text, wanted) in enumerate(zip(column.to_pylist(), numbers.to_pylist())):
        cut = (text or "").split("\n")
        for w in wanted:
            if w["number"] < len(cut):      # rows with one id may differ in length
                rows.append(row), found.append(w["number"]), bits.append(w["shared"]), lines.append(cut[w["number"]])
    return rows, found, bits, lines


def _variants(picked: DataFrame, least: int | None) -> DataFrame:
    """``key, role, doc_id, number, line`` for the listed lines of packed texts."""
    schema = (picked.select("doc_id").schema.add("number", "integer").add("key", "long")
              .add("role", "integer").add("line", "string"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, len(big), 256):
                batch = big.slice(at, 256)
                rows, numbers, bits, lines = _chosen_lines(unpack_text(batch.column(1)), batch.column(2))
                cut = Lines(pa.array(lines, pa.string()), least)
                line, key, role = cut.variants(np.array(bits, dtype=np.int64)[cut.doc])
                line = cut.doc[line]
                # the text goes along once, with the line's own entry
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64()).take(pa.array(line))),
                     pa.array(numbers, pa.int32()).take(pa.array(line)), pa.array(key.view(np.int64)), pa.array(role),
                     pa.array([lines[i] if r == 2 else None for i, r in zip(line.tolist(), role.tolist())], pa.string())],
                    schema.names)

    return map_arrow(picked.select("doc_id", "packed", "numbers"), work, schema)


def _packed(docs: DataFrame) -> DataFrame:
    schema = docs.select("doc_id").schema.add("packed", "binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pack_text(batch.column(1))], schema.names)

    return map_arrow(docs.select("doc_id", "text"), work, schema)


def repeated_lines(docs: DataFrame, least: int | None = None) -> DataFrame:
    """``doc_id, number`` of the first sighting of every line that stays.

    Of lines with equal words the first in order of id and line number stays,
    unless a line before it is within one edit of it. Lines without a word,
    and those of fewer than ``least`` if that is given, are not listed.
    """
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "number")
    named = _line_names(docs, least)
    classes = stage(named.groupBy("high", "low")
                    .agg(F.min(F.struct(place.alias("place"), "k0", "k1", "k2", "k3")).alias("f"))
                    .select("high", "f.place.doc_id", "f.place.number", "f.k0", "f.k1", "f.k2", "f.k3"))
    keys = F.array("k0", "k1", "k2", "k3")
    edited = classes.filter("k0 IS NOT NULL")
    shared = (edited.select("high", F.explode(keys).alias("key")).groupBy("key")
              .agg(F.min("high").alias("lo"), F.max("high").alias("hi")).filter("lo <> hi").select("key"))
    near = stage(edited.select("doc_id", "number", F.posexplode(keys).alias("kind", "key")).join(shared, "key", "left_semi")
                 .groupBy("doc_id", "number").agg(F.bit_or(F.expr("shiftleft(1, kind)")).alias("shared")))
    wanted = near.groupBy("doc_id").agg(F.collect_list(F.struct("number", "shared")).alias("numbers"))
    packed = _packed(docs).withColumnRenamed("doc_id", "_id")
    # the list grows with the corpus: merged at every size, never broadcast
    picked = (packed.join(wanted.hint("merge"), F.col("_id").eqNullSafe(F.col("doc_id")))
              .select("doc_id", "packed", "numbers"))
    found = stage(_variants(picked, least).withColumn("place", place).withColumn("alike", F.col("role") == 0)
                  .select("key", "alike", "role", "place", "line"))
    groups = stage(found.groupBy("key", "alike")
                   .agg(F.min("place").alias("lead"), F.max("place").alias("tail"),
                        F.min(F.when(F.col("role") == 2, F.col("place"))).alias("own"))
                   .filter("lead <> tail").drop("tail"))
    # a line without a unit is led by the line that is just so; all others by the first
    lead = F.when(F.col("role") == 1, F.col("own")).otherwise(F.col("lead"))
    pairs = stage(found.drop("line").join(groups, ["key", "alike"]).withColumn("before", lead)
                  .filter(F.col("before") < F.col("place")).select("place", "before").distinct())
    lines = stage(found.filter("role = 2").select(
        "place", _units(F.col("line"), least).alias("units")).distinct())
    later = lines.withColumnRenamed("units", "w")
    earlier = lines.select(F.col("place").alias("before"), F.col("units").alias("v"))
    dropped = stage(pairs.join(later, "place").join(earlier, "before")
                    .filter(within_one_edit(F.col("w"), F.col("v"))).select("place").distinct())
    return classes.select(place.alias("place")).join(dropped, "place", "left_anti").select("place.doc_id", "place.number")


def line_dedup(docs: DataFrame, least: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Remove repeated lines, exact or with one edit; adds ``n_lines, n_dropped``.

    Lines end at ``\\n`` and are compared word by word (words between ASCII
    white space, case as it is). A line is dropped if an earlier line of the
    corpus, in order of id and line number, has the same words, whatever their
    number, or differs by one edit - whether or not that one stays. One edit is
    an inserted, deleted or replaced word between lines of ``EDIT_WORDS`` words
    or more, and such a character, white space apart, between shorter lines of
    ``EDIT_CHARACTERS`` or more, as in scripts without spaces. Blank lines
    always stay. With ``least``, lines of fewer words always stay and all
    others are compared for edits by words. The kept lines of a text
    are joined again; a NULL text stays NULL with 0 lines. Ids come in their
    order, NULL last, as one id. Rows repeated with one id count as one: line k of each
    stays if that of any of them is a first sighting. Other columns are kept;
    the two new ones replace columns of those names.

    Lines travel as hashes. A substitution leaves one half of a line alone, a
    deletion one half of the shorter length, so only lines that share a half
    with another emit their deletion variants; lines with an equal variant key
    are verified on their words. Each line is compared with the first of its
    key only, so a common line costs one pair for each variant of it.
    """
    bound_batches(docs.sparkSession)
    added = ("n_lines", "n_dropped")
    keep = [c for c in docs.columns if c not in added]
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    stays = (repeated_lines(source, least).groupBy(F.col("doc_id").alias("_id"))
             .agg(F.collect_list("number").alias("_stays")))
    at, body = keep.index(doc_id), keep.index(text)
    schema = docs.select(*keep).schema
    # numbered on the way, so that no name of the table can clash
    packed_schema = T.StructType([T.StructField(f"c{i}", T.BinaryType() if i == body else f.dataType)
                                  for i, f in enumerate(schema.fields)])

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[body] = pack_text(columns[body])
            yield pa.RecordBatch.from_arrays(columns, packed_schema.names)

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for first in range(0, len(big), 512):
                batch = big.slice(first, 512)
                texts = unpack_text(batch.column(body))
                lines = Lines(texts, least)
                stays_ = [set(x or ()) for x in batch.column(len(keep)).to_pylist()]
                gone: list[set[int]] = [set() for _ in range(len(batch))]
                for row, number in zip(lines.doc.tolist(), lines.number.tolist()):
                    if number not in stays_[row]:
                        gone[row].add(number)
                out, total = [], []
                for text_, drop in zip(texts.to_pylist(), gone):
                    cut = text_.split("\n") if text_ is not None else []
                    total.append(len(cut))
                    out.append(None if text_ is None else "\n".join(
                        x for i, x in enumerate(cut) if i not in drop) if drop else text_)
                columns = list(batch.columns[:len(keep)])
                columns[body] = pa.array(out, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(total, pa.int32()), pa.array([len(g) for g in gone], pa.int32())],
                    [*keep, *added])

    packed = map_arrow(docs.select(*keep), shrink, packed_schema)
    joined = packed.join(stays, F.col(f"c{at}").eqNullSafe(F.col("_id")), "left").drop("_id")
    result = T.StructType([*schema.fields, T.StructField("n_lines", T.IntegerType()),
                           T.StructField("n_dropped", T.IntegerType())])
    return map_arrow(joined, rebuild, result)
