"""Near-duplicate groups: SuperMinHash, banding, exact verification, union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .graph import components
from .hashing import U64, mix, pack_text, shingle_sets, unpack_text
from .text import bound_batches, map_arrow

LEVEL = U64(56)                    # a slot's value: permutation rank above, random part below
EMPTY = U64(0xFFFFFFFFFFFFFFFF)
GROUP = 1 << 15                    # elements handled at once


def _draw(values: np.ndarray, rank: int, left: int) -> tuple[np.ndarray, np.ndarray]:
    """Per element: a number below ``left`` and the slot value at this rank."""
    r = mix(values + U64((rank + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
    return ((r >> U64(32)) * U64(left) >> U64(32)).astype(np.int64), (U64(rank) << LEVEL) | (mix(r) >> U64(8))


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash signatures, one row of ``slots`` numbers per set.

    Every element walks its own random permutation of the slots (Fisher-Yates)
    and offers rank + uniform to the slot it meets at each rank; a slot keeps
    the least offer. Offers of a set are thus spread evenly over the slots,
    which gives a lower variance than independent hashes. A set stops at the
    rank that can no longer lower any slot: large ones after the first or
    second. Slots of an empty set stay ``EMPTY``.
    """
    out = np.full((len(sets), slots), EMPTY, dtype=U64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    first = 0
    while first < len(sets):
        last = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), GROUP)))
        _sign(sets[first:last], sizes[first:last], slots, out[first:last])
        first = last
    return out


def _sign(sets: list[np.ndarray], sizes: np.ndarray, slots: int, out: np.ndarray) -> None:
    flat = out.reshape(-1)
    values = np.concatenate(sets) if sets else np.empty(0, U64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    slot, offer = _draw(values, 0, slots)
    np.minimum.at(flat, owner * slots + slot, offer)
    order = None
    for rank in range(1, slots):
        open_ = (out.max(axis=1) >> LEVEL) >= U64(rank)
        live = open_[owner]
        if not live.any():
            return
        if order is None:
            values, owner, slot = values[live], owner[live], slot[live]
            order = np.tile(np.arange(slots, dtype=np.uint16), (len(values), 1))
            rows = np.arange(len(values))
            order[rows, slot] = 0
        elif not live.all():
            values, owner, order = values[live], owner[live], order[live]
            rows = np.arange(len(values))
        at, offer = _draw(values, rank, slots - rank)
        at += rank
        slot = order[rows, at].astype(np.int64)
        order[rows, at] = order[rows, rank]
        np.minimum.at(flat, owner * slots + slot, offer)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` slots."""
    n, slots = signatures.shape
    bands = slots // rows
    acc = np.tile(np.arange(1, bands + 1, dtype=U64), (n, 1))
    for i in range(rows):
        acc = mix(acc * U64(0x9E3779B97F4A7C15) + signatures[:, i:bands * rows:rows])
    return acc


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def sketches(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, n, set_id, bands``: a set's size, 128-bit identity and band keys."""
    schema = docs.select("doc_id").schema.add("n", "long").add("set_id", "binary").add("bands", T.ArrayType(T.LongType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, len(big), 512):
                batch = big.slice(at, 512)
                sets = shingle_sets(batch.column(1), shingle)
                keys = band_keys(super_minhash(sets, bands * rows), rows)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    _lists([k if len(s) else k[:0] for k, s in zip(keys, sets)])],
                    ["doc_id", "n", "set_id", "bands"])

    return map_arrow(docs.select("doc_id", "text"), work, schema)


def token_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``node, n, tokens`` from ``node, packed``: the sets as sorted arrays."""
    schema = docs.select("node").schema.add("n", "integer").add("tokens", T.ArrayType(T.LongType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, len(big), 512):
                batch = big.slice(at, 512)
                sets = shingle_sets(unpack_text(batch.column(1)), shingle)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in sets], pa.int32()), _lists(sets)],
                    ["node", "n", "tokens"])

    return map_arrow(docs.select("node", "packed"), work, schema)


def _packed(docs: DataFrame) -> DataFrame:
    schema = docs.select("doc_id").schema.add("packed", "binary")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pack_text(batch.column(1))], ["doc_id", "packed"])

    return map_arrow(docs.select("doc_id", "text"), work, schema)


def prefix_entries(sets: DataFrame, percent: int) -> DataFrame:
    """``token, node, n, at, common``: each set's necessary prefix, rarest tokens first.

    Two sets of the wanted similarity share a token in these prefixes. ``at``
    is the token's rank in its set, ``common`` the mean count of the set's
    tokens. Tokens are counted exactly. Those of one set alone come first and
    are left out: the rest of the prefix is taken from the shared ones, so a
    set's entries depend on what it shares and not on the size of the corpus.
    """
    tokens = sets.select("row", "node", "n", F.explode("tokens").alias("token"))
    held = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("held")).filter("held > 1")
    own = Window.partitionBy("row", "node", "n")
    alone = F.col("n") - F.col("shared")
    size = F.col("n") - F.ceil(F.col("n").cast("long") * percent / 100) + 1
    return (tokens.join(held, "token")
            .withColumns({"place": F.row_number().over(own.orderBy("held", "token")),
                          "shared": F.count(F.lit(1)).over(own), "sum": F.sum("held").over(own)})
            .withColumn("at", (alone + F.col("place") - 1).cast("int"))
            .filter(F.col("at") < size)
            .select("node", "token", "n", "at", ((alone + F.col("sum")) / F.col("n")).cast("float").alias("common")))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    joint = F.size(F.array_intersect("ta", "tb"))
    union = F.size("ta") + F.size("tb") - joint
    return (pairs.join(left, "a").join(right, "b")
            .filter(joint.cast("long") * 100 >= union.cast("long") * percent).select("a", "b"))


def links_between(sets: DataFrame, percent: int) -> DataFrame:
    """Verified links ``a, b`` that connect all similar sets.

    Pairs come from prefix tokens. Of each token's sets, the one with the most
    common tokens leads; every set is verified against its best leader first
    and groups are merged. Only pairs that share a token but are not yet in one
    group, and whose sizes and token ranks leave room for the wanted overlap,
    are verified one by one; so a large group costs as many pairs as it has
    members, and no link between groups is missed.
    """
    entries = stage(prefix_entries(sets, percent))
    leader = F.struct(F.col("common"), F.col("n"), F.col("node"))
    leaders = (entries.groupBy("token").agg(F.max(leader).alias("lead"), F.count(F.lit(1)).alias("held"))
               .filter("held > 1"))
    low, high = F.least("n", "lead.n"), F.greatest("n", "lead.n")
    stars = (entries.join(leaders, "token").filter((F.col("node") != F.col("lead.node")) & (low * 100 >= high * percent))
             .groupBy("node").agg(F.max("lead").alias("lead"))
             .select(F.greatest("node", "lead.node").alias("a"), F.least("node", "lead.node").alias("b")).distinct())
    first = stage(verified(stage(stars), sets, percent))
    groups = components(first)
    placed = entries.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spread = (placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
              .filter("lo <> hi").select("token"))
    placed = stage(placed.join(spread, "token", "left_semi").select("token", "node", "n", "at", "component"))
    one, two = placed.alias("x"), placed.alias("y")
    need = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent) - 1e-9)
    rest = (one.join(two, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") < F.col("y.component"))
                     & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
                     & (F.col("x.n") - F.col("x.at") >= need) & (F.col("y.n") - F.col("y.at") >= need))
            .select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct())
    return first.union(verified(stage(rest), sets, percent))


def near_dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 5,
               doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of near-duplicate documents, one row per input row.

    ``doc_id, n_shingles, component_id, kept``. Texts are compared as sets of
    ``shingle``-word shingles, A-Z lower-cased; with fewer words the whole
    sequence is the one shingle. Documents are linked when 100 times the
    intersection is at least ``percent`` times the union; ``component_id`` is
    the smallest id that links reach. A NULL text or one without words has an
    empty set and no link. Rows repeated with one id are one document: it links
    wherever one of its texts does. A NULL id is linked with nothing, its
    component is NULL and it is kept. Other columns are ignored.

    Equal sets are one node. Nodes whose SuperMinHash signatures share no band
    with another's are settled: two sets at the threshold stay apart in all
    bands with probability ``(1 - s^rows)^bands``, 3e-6 at 0.8 and 7e-9 at
    0.85 with the defaults. All others are compared exactly (``links_between``).
    """
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    drawn = stage(sketches(source, shingle, bands, rows))
    nodes = stage(drawn.filter(F.col("set_id").isNotNull() & F.col("doc_id").isNotNull())
                  .groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")))
    copies = (drawn.join(nodes.select("set_id", "node"), "set_id")
              .filter(F.col("doc_id") != F.col("node")).select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    entries = nodes.select("node", F.explode_outer("bands").alias("key")).filter(F.col("key").isNotNull())
    shared = (entries.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
              .filter("lo <> hi").select("key"))
    candidates = stage(entries.join(shared, "key", "left_semi").select("node").distinct())
    texts = (_packed(source).withColumnRenamed("doc_id", "node").join(candidates, "node", "left_semi"))
    sets = stage(token_sets(texts, shingle).withColumn("row", F.monotonically_increasing_id()))
    groups = components(links_between(sets, percent).union(copies))
    found = drawn.join(groups, drawn["doc_id"] == groups["node"], "left")
    component = F.coalesce("component", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        component.eqNullSafe(F.col("doc_id")).alias("kept"))
