"""MinHash near-duplicates by a multi-index Hamming join.

A document's set holds its distinct 2-word shingles (A-Z in lower case; of fewer words the whole sequence as one). Its
signature has ``SLOTS`` minima of ``BITS`` bits. Signatures are split into ``CHUNKS`` chunks of four or five slots; two
signatures that differ in at most ``DISTANCE`` slots differ in at most one slot of some chunk (pigeonhole), so each signature
emits, for every chunk and every slot of it, a key of the other slots, and any such pair meets at a key.

Of a pair with a similarity of 0.8 each slot differs with a probability of 0.2 (``SLOTS`` independent minima), so it meets at no key
with a probability of ``miss_probability(0.8)``, below 1e-9.

1. Equal sets are one node (two 64-bit sums over their shingle hashes). Only nodes emit keys.
2. The smallest node at a key is its hub. Two nodes that meet at a key share its hub, and a node has few distinct hubs, so groups of
   nodes around hubs stand for all keys. No pair is listed.
3. Links between a node and its hubs are confirmed on full sets; the members of a hub stream past its set, a large
   group in parts.
4. Components of these links leave groups with several components. Their members are dealt into tiles of about ``TILE``; members
   outside the group's commonest component stream past every tile, and are held against all of it by an inverted list over
   shingles. Links between components are confirmed on full sets in the same step, so every pair that meets is in one component
   or was compared; rows grow with the members, not with their pairs.

What step 4 computes (not what it writes) grows with members times those outside the commonest component.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import words
from .common import rows_of, saved, text_bytes, unsqueezed

SLOTS = 64
BITS = 16
CHUNKS = 14
DISTANCE = 2 * CHUNKS - 1
SHINGLE = 2
TILE = 256
FILTER_BITS = 26
#: Hubs (a few numbers each) that are broadcast at most; more of them are joined by a shuffle.
MOST_HUBS = 200_000
_BOUNDS = [round(i * SLOTS / CHUNKS) for i in range(CHUNKS + 1)]
_RNG = np.random.default_rng(42)
_TIMES = _RNG.integers(0, 1 << 63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, SLOTS, dtype=np.uint64)


def miss_probability(similarity: float) -> float:
    """The probability that a pair of this similarity meets at no key."""
    same, miss = similarity, 1.0
    for low, high in zip(_BOUNDS, _BOUNDS[1:], strict=False):
        c = high - low
        miss *= 1 - sum(comb(c, e) * (1 - same) ** e * same ** (c - e) for e in (0, 1))
    return miss


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty without words."""
    out: list[np.ndarray] = []
    for low, high in words.blocks(texts):
        _, _, h, first = words.hashed_words([t.lower() for t in texts[low:high]])
        pairs = words.runs(h, SHINGLE)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            found = np.sort(pairs[a : b - 1] if b - a > 1 else h[a:b])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found)
    return out


def sums(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit sums a set; equal sets have equal ones."""
    return np.array([(s.sum(dtype=np.uint64), words.mix(s).sum(dtype=np.uint64)) for s in sets], dtype=np.uint64).reshape(-1, 2)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """``SLOTS`` minima of ``BITS`` bits for each set, none of them empty."""
    out = np.empty((len(sets), SLOTS), dtype="<u2")
    if sets:
        h = np.concatenate(sets)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
        for k in range(SLOTS):
            out[:, k] = words.mix(np.minimum.reduceat((h ^ _PLUS[k]) * _TIMES[k], starts)) >> np.uint64(64 - BITS)
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """One key a slot for each signature: of the slot's chunk without that slot."""
    keys = np.empty((len(signature), SLOTS), dtype=np.uint64)
    wide = signature.astype(np.uint64)
    for low, high in zip(_BOUNDS, _BOUNDS[1:], strict=False):
        for left_out in range(low, high):
            h = np.full(len(wide), left_out, dtype=np.uint64)
            for k in range(low, high):
                if k != left_out:
                    h = words.mix(h * np.uint64(1 << BITS) + wide[:, k])
            keys[:, left_out] = h
    return keys


def similar(a: np.ndarray, b: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Sizes ``a`` and ``b`` with ``both`` in common: a Jaccard similarity of 0.8 or more."""
    return 100 * both >= 80 * (a + b - both)


def _sketched(docs: DataFrame) -> DataFrame:
    """``doc_id, n, h1, h2, sig`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 4 << 20):
            sets = shingle_sets(text_bytes(batch.column("text")))
            n = np.array([len(s) for s in sets], dtype=np.int64)
            total = sums(sets).view(np.int64)
            some = signatures([s for s in sets if len(s)])
            packed = iter(some)
            sig = pa.array([next(packed).tobytes() if k else None for k in n.tolist()], pa.binary())
            columns = [batch.column("doc_id"), pa.array(n), pa.array(total[:, 0]), pa.array(total[:, 1]), sig]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "h1", "h2", "sig"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sig binary")


def _keys(nodes: DataFrame) -> DataFrame:
    """``key, node``: what each node emits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), dtype="<u2").reshape(-1, SLOTS)
                node = np.repeat(part.column("node").to_numpy(), SLOTS)
                yield pa.RecordBatch.from_arrays([pa.array(chunk_keys(sig).view(np.int64).reshape(-1)), pa.array(node)], ["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def hub_pairs(nodes: DataFrame) -> DataFrame:
    """``node, hub``: a node and the smallest node at one of its keys, each once."""
    keys = _keys(nodes)
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "hub")
    return keys.join(hubs, "key").where("node != hub").select("node", "hub").distinct()


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, body`` for the nodes of ``wanted`` (``h1, h2, node``): a text of each, as a zstandard frame.

    A filter of 2 ** FILTER_BITS bits (of fixed size, filled on the executors) keeps most other texts out of the
    shuffle; the join is exact.
    """
    spark = docs.sparkSession
    bit = F.col("h1").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    each = 32768
    spots = wanted.select((bit / each).cast("long").alias("at"), (bit % each).cast("long").alias("bit"))
    held = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for at, bits in spots.groupBy("at").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).collect():
        held[at * each // 8 : (at + 1) * each // 8] = np.frombuffer(bits, dtype=np.uint8)
    shared = spark.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in rows_of(batches, 4 << 20):
            texts = text_bytes(batch.column("text"))
            total = sums(shingle_sets(texts))
            spot = (total[:, 0] & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
            at = np.flatnonzero(shared.value[spot >> 3] >> (spot & 7).astype(np.uint8) & 1)
            frames = pa.array([press.compress(texts[i].lower()) for i in at.tolist()], pa.binary())
            own = total.view(np.int64)[at]
            yield pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), frames], ["h1", "h2", "body"])

    found = docs.select("text").mapInArrow(run, "h1 long, h2 long, body binary")
    return found.groupBy("h1", "h2").agg(F.min("body").alias("body")).join(wanted, ["h1", "h2"]).select("node", "body")


class _Tile:
    """The sets that a group holds, as an inverted list over shingles."""

    def __init__(self) -> None:
        self.sets: list[np.ndarray] = []
        self.nodes: list[int] = []
        self.parts: list[int] = []
        self.ready = False

    def add(self, node: int, part: int, shingles: np.ndarray) -> None:
        self.nodes.append(node)
        self.parts.append(part)
        self.sets.append(shingles)

    def links(self, part: int, shingles: np.ndarray) -> list[tuple[int, int]]:
        """``(held part, part)`` of the confirmed links of a set to sets of other parts, each part once."""
        if not self.ready:
            every = np.concatenate(self.sets) if self.sets else np.empty(0, np.uint64)
            self.size = np.array([len(s) for s in self.sets], dtype=np.int64)
            owner = np.repeat(np.arange(len(self.sets)), self.size)
            order = np.argsort(every, kind="stable")
            self.hash, self.owner, self.part, self.ready = every[order], owner[order], np.array(self.parts, dtype=np.int64), True
        low, high = np.searchsorted(self.hash, shingles, "left"), np.searchsorted(self.hash, shingles, "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if n.any() else np.empty(0, np.int64)
        both = np.bincount(self.owner[at], minlength=len(self.size))
        near = (both > 0) & (self.part != part) & similar(self.size, len(shingles), both)
        return [(p, part) for p in np.unique(self.part[near]).tolist()]


def _confirmed(dealt: DataFrame) -> DataFrame:
    """``a, b``: confirmed links between the parts of probes and those of the rows held in their group (``hub, tile``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, tile = None, _Tile()
        for batch in rows_of(batches, 1 << 20):
            sets = shingle_sets(unsqueezed(batch.column("body")))
            found: set[tuple[int, int]] = set()
            columns = [batch.column(c).to_pylist() for c in ("hub", "tile", "probe", "node", "part")]
            for (hub, at, probe, node, part), shingles in zip(zip(*columns, strict=True), sets, strict=True):
                if group != (hub, at):
                    group, tile = (hub, at), _Tile()
                if probe:
                    found.update(tile.links(part, shingles))
                else:
                    tile.add(node, part, shingles)
            if found:
                a, b = zip(*sorted(found), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    rows = dealt.select("hub", "tile", "probe", "node", "part", "body")
    return rows.repartition("hub", "tile").sortWithinPartitions("hub", "tile", "probe").mapInArrow(run, "a long, b long").distinct()


def _by_hub(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """``rows`` with what ``sized`` has for their hub; few hubs are broadcast, so that a hub of many members stays where its rows are."""
    held = saved(sized)
    return rows.join(F.broadcast(held) if held.limit(MOST_HUBS + 1).count() <= MOST_HUBS else held, "hub")


def _hub_links(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """``a, b``: the confirmed links of nodes to their hubs. A hub of many members is held once for every ``TILE`` of them."""
    sized = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    held = sized.select("hub", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(0).alias("probe"), F.col("hub").alias("node"))
    probes = _by_hub(pairs, sized).select("hub", F.pmod(F.xxhash64("node"), "tiles").cast("int").alias("tile"), F.lit(1).alias("probe"), "node")
    return _confirmed(held.unionByName(probes).join(bodies, "node").withColumn("part", F.col("node")))


def _other_links(pairs: DataFrame, bodies: DataFrame, parts: DataFrame) -> DataFrame:
    """``a, b``: confirmed links between different parts of a hub's group (``parts``: ``node, part`` of nodes with links)."""
    members = pairs.unionByName(pairs.select(F.col("hub").alias("node"), "hub").distinct())
    members = members.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    each = members.groupBy("hub", "part").agg(F.count(F.lit(1)).alias("n"))
    sized = each.groupBy("hub").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_parts"), F.max_by("part", F.struct("n", "part")).alias("common"))
    sized = sized.where("n_parts > 1").select("hub", "common", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    among = _by_hub(members, sized)
    held = among.select("hub", F.pmod(F.xxhash64("node"), "tiles").cast("int").alias("tile"), F.lit(0).alias("probe"), "node", "part")
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")
    probes = among.where("part != common").select("hub", every, F.lit(1).alias("probe"), "node", "part")
    return _confirmed(held.unionByName(probes).join(bodies, "node"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (``doc_id, text``; other columns are ignored).

    component_id is the smallest doc_id reachable over links of similarity 0.8 or more, the document's own included; kept says that
    it is the own one. A null, empty or wordless text has no shingles and is linked with nothing. A null id names no
    component unless it has no other; rows that repeat are linked and, having one id, kept or not together. An empty table gives no rows.
    """
    held = saved(_sketched(docs))
    some = held.where("n > 0")
    nodes = saved(some.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.min("sig").alias("sig"), F.count(F.lit(1)).alias("rows")))
    nodes = nodes.withColumn("node", F.monotonically_increasing_id())  # of a saved table: the same at each reading
    pairs = saved(hub_pairs(nodes))
    met = pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node"))).distinct()
    bodies = saved(_bodies(docs, saved(nodes.select("h1", "h2", "node").join(met, "node"))))
    first = connected_components(_hub_links(pairs, bodies), "a", "b").select("node", F.col("component").alias("part")).distinct()
    second = connected_components(_other_links(pairs, bodies, first), "a", "b").withColumnsRenamed({"node": "part", "component": "whole"})
    named = nodes.select("h1", "h2", "node", "least", "rows").join(first, "node", "left").withColumn("part", F.coalesce("part", "node"))
    named = saved(named.join(second, "part", "left").withColumn("whole", F.coalesce("whole", "part")))
    least = named.groupBy("whole").agg(F.min("least").alias("component_id"))
    named = saved(named.join(least, "whole").select("h1", "h2", "component_id", "rows"))
    # a set of over a thousandth of all rows is met by a broadcast of at most a thousand, so no task gets all its rows
    often = named.where(F.col("rows") > max(1000, (named.agg(F.sum("rows")).first()[0] or 0) // 1000))
    marked = some.join(F.broadcast(often.select("h1", "h2", "component_id", F.lit(True).alias("often"))), ["h1", "h2"], "left")
    others = marked.where("often is null").drop("component_id", "often").join(named.drop("rows"), ["h1", "h2"])
    columns = ["doc_id", "n", "component_id"]
    alone = held.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = marked.where("often").select(columns).unionByName(others.select(columns)).unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
