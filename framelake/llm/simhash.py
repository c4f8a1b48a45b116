"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits: bit k is set if over half of the document's 3-word shingles
(XXH64, seed 42) have it set. Two fingerprints link at 3 or fewer differing bits.

Every fingerprint emits the values within half of that radius and meets the others there.
The radius is odd, so of two fingerprints at distance 3 one has an even and the other an odd
number of set bits: even ones emit radius 2, odd ones radius 1. Of three differing bits two
lie in the same half of the word, so only pairs of flips within a half are emitted. Then

- a value with an odd number of bits holds even fingerprints one flip away and at most the odd
  one that equals it: all of them are within 2 of one another;
- a value with an even number of bits holds odd fingerprints one flip away (within 2 of one
  another) and even ones up to two flips away (within 3 of every odd one).

So the fingerprints that meet at a value all link to the smallest odd one there (at odd values:
to the smallest), and a star of verified links stands for all pairs: rows grow with the
fingerprints, not with the square of a group. Exact copies are one fingerprint.

Emitting costs up to 1,057 rows a fingerprint, so fingerprints that cannot have a partner
are dropped first, losslessly: of eight bytes at most three can differ, hence two
linked fingerprints agree in five bytes; those that share no five bytes with another emit nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import order_key, prefix, rows_of, saved, text_bytes, with_fields

SHINGLE = 3
RADIUS = 3
SEED = 42
_CHUNK = 1 << 18
_EACH_BYTE = np.uint64(0x0101010101010101)


def _votes(h: np.ndarray) -> np.ndarray:
    """For each of 64 bits the number of hashes that have it set (counted in bytes, 255 hashes at a time)."""
    counts = np.zeros(64, dtype=np.int64)
    whole = len(h) // 255 * 255
    for bit in range(8):
        ones = (h >> np.uint64(bit)) & _EACH_BYTE
        sums = [ones[:whole].reshape(-1, 255).sum(axis=1, dtype=np.uint64), ones[whole:].sum(keepdims=True, dtype=np.uint64)]
        counts[bit::8] += np.concatenate(sums).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text; 0 without words. Bytes outside A-Z stay as they are."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    counts = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _CHUNK):
        part = zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in part), dtype=np.uint64)
        counts += _votes(h)
    set_bits = counts * 2 > len(starts)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, the columns ``more`` and ``fp`` (a signed long) for every row."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, "text")
    names = ["doc_id", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = np.array([fingerprint(t) for t in text_bytes(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(found.view(np.int64))], [*names, "fp"])

    return slim.mapInArrow(run, with_fields(slim.select(*names), "fp long"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _byte_masks() -> list[int]:
    return [_signed(sum(0xFF << (8 * b) for b in kept)) for kept in combinations(range(8), 8 - RADIUS)]


def _flips() -> tuple[list[int], list[int]]:
    """Masks of radius 1 (with 0) and of the pairs within a half."""
    one = [0, *(1 << i for i in range(64))]
    two = [(1 << i) | (1 << j) for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)]
    return [_signed(x) for x in one], [_signed(x) for x in two]


def _longs(values: list[int]):
    return F.expr("array(" + ",".join(f"{v}L" if v > -(2**63) else "(-9223372036854775807L - 1L)" for v in values) + ")")


def candidates(distinct: DataFrame) -> DataFrame:
    """The fingerprints that agree with another in five of eight bytes."""
    masks = _longs(_byte_masks())
    keyed = distinct.select("fp", F.posexplode(masks).alias("i", "mask")).select("fp", "i", F.col("fp").bitwiseAND(F.col("mask")).alias("part"))
    same = Window.partitionBy("i", "part")
    return keyed.withColumn("n", F.count(F.lit(1)).over(same)).where("n > 1").select("fp").distinct()


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: stars of verified links whose components are those of all links."""
    one, two = _flips()
    odd = F.col("fp_odd") == 1
    met = (
        candidates(distinct)
        .withColumn("fp_odd", F.bit_count("fp") % 2)
        .select("fp", "fp_odd", F.explode(F.when(odd, _longs(one)).otherwise(_longs(one + two))).alias("flip"))
        .select("fp", "fp_odd", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    )
    at = Window.partitionBy("value")
    value_odd = F.bit_count("value") % 2 == 1
    hub = F.when(value_odd, F.min("fp").over(at)).otherwise(F.min(F.when(odd, F.col("fp"))).over(at))
    stars = met.withColumn("hub", hub).where(F.col("hub").isNotNull() & (F.col("hub") != F.col("fp")))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= RADIUS
    return stars.where(near).select(F.greatest("fp", "hub").alias("a"), F.least("fp", "hub").alias("b")).distinct()


def _with_components(distinct: DataFrame) -> DataFrame:
    """``distinct`` (one row a fingerprint) with ``component``, the smallest fingerprint reachable over links."""
    labels = connected_components(links(distinct), "a", "b")
    return distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    component_id is the smallest doc_id reachable over links, the document's own included.
    A null or wordless text has the fingerprint 0, linked like any other; null ids never name a
    component unless it has no other id; repeated rows link at distance 0; an empty table gives
    no rows; other columns are ignored.
    """
    held = saved(fingerprints(docs))
    distinct = saved(held.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    node = _with_components(distinct)
    names = node.groupBy("component").agg(F.min("least").alias("component_id"))
    named = saved(node.join(names, "component").select("fp", "component_id", "n"))
    # a fingerprint of over a thousandth of all rows is met by a broadcast of at most a thousand, so no task gets all its rows
    often = named.where(F.col("n") > max(1000, (named.agg(F.sum("n")).first()[0] or 0) // 1000))
    marked = held.join(F.broadcast(often.select("fp", "component_id", F.lit(True).alias("often"))), "fp", "left")
    others = marked.where("often is null").select("fp", "doc_id").join(named.drop("n"), "fp")
    out = marked.where("often").select("fp", "doc_id", "component_id").unionByName(others.select("fp", "doc_id", "component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component stays: the row with its smallest id (null counts as the smallest), of several
    texts under that id the one with the smallest MD5 (null first), of equal rows one; the columns of ``docs``.

    Ids may be null or repeat across components, so a row is known by its id and the MD5 of its text.
    """
    p = prefix(docs)
    key = [f"{p}id", f"{p}text"]
    keyed = docs.withColumns({key[0]: order_key("doc_id"), key[1]: F.coalesce(F.unhex(F.md5("text")), F.lit(b""))})
    held = fingerprints(keyed.select(F.col(key[0]).alias("doc_id"), "text", key[1]), key[1])
    distinct = saved(held.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").alias(key[0]), key[1])).alias("first")))
    stay = _with_components(distinct).groupBy("component").agg(F.min("first").alias("first")).select("first.*")
    order = [F.col(f.name) for f in docs.schema.fields if f.name != "text" and "map<" not in f.dataType.simpleString()]
    least = F.min_by(F.struct(*docs.columns), F.struct(*order))
    return keyed.join(stay, key, "left_semi").groupBy(*key).agg(least.alias(f"{p}row")).select(f"{p}row.*")
