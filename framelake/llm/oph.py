"""Document fingerprints by one-permutation MinHash.

The shingles of a text (five words; a shorter text is one shingle) are hashed once.
The top bits of a hash name its bin, and each bin keeps its smallest value. An empty bin
takes the value of a bin drawn by a fixed sequence of hashes of (bin, attempt) - optimal
densification - so that equal positions agree with the probability of the Jaccard
likeness. Of each value the low ``BITS`` bits are stored, packed into a hexadecimal
string. Two unrelated values agree by chance once in 2**BITS; the likeness estimate
takes that bias out: (agreement - 2**-b) / (1 - 2**-b), held to 0..1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import order_key, partitions, rows_of, text_bytes, with_fields
from .words import blocks, hashed_words, mix, runs

BINS = 256
BITS = 8
SHINGLE = 5
_BIN_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
#: What stands for a null id.
NO_ID = -(2**63)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


@cache
def _donors(attempt: int) -> np.ndarray:
    """For each bin the bin it asks at this attempt."""
    asked = np.arange(BINS, dtype=np.uint64) * np.uint64(2654435761) + np.uint64(attempt * 0x9E3779B97F4A7C15 % 2**64)
    return (mix(asked) >> _BIN_SHIFT).astype(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray | None:
    """The low bits of the densified bins; None for a text without words."""
    if not len(shingles):
        return None
    value = np.full(BINS, _FULL, dtype=np.uint64)
    h = mix(shingles)
    np.minimum.at(value, (h >> _BIN_SHIFT).astype(np.int64), h)
    empty = value == _FULL
    out = value.copy()
    left = np.flatnonzero(empty)
    attempt = 0
    while len(left):
        donor = _donors(attempt)[left]
        good = ~empty[donor]
        out[left[good]] = value[donor[good]]
        left = left[~good]
        attempt += 1
    return (mix(out) & np.uint64((1 << BITS) - 1)).astype(np.uint8)


def sketches(texts: list[bytes]) -> list[np.ndarray | None]:
    found: list[np.ndarray | None] = []
    for a, b in blocks(texts):
        _, _, h, first = hashed_words(texts[a:b])
        for i in range(b - a):
            own = h[first[i] : first[i + 1]]
            found.append(sketch(runs(own, min(SHINGLE, len(own))) if len(own) else own))
    return found


def packed(values: np.ndarray | None) -> str:
    """The stored form; a text without words has the empty fingerprint."""
    return "" if values is None else values.tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard likeness; two texts without words are alike (1), one such text and another are not (0)."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-BITS
    return min(1.0, max(0.0, (float(np.mean(a == b)) - chance) / (1 - chance)))


def _bounds(docs: DataFrame, parts: int) -> np.ndarray:
    """Ids in ascending order that cut the table into about ``parts`` equal ranges; a frequent id stands there several times."""
    at = [i / parts for i in range(1, parts)]
    row = docs.agg(F.percentile_approx("__id", at, 20 * parts).alias("q")).first() if at else None
    return np.sort(np.array((row and row.q) or [], dtype=np.int64))


def _bucket(ids: np.ndarray, turn: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Bucket 0 holds the largest ids. An id that cuts k times has k buckets, dealt by the rank that its texts' hashes give."""
    behind, before = np.searchsorted(bounds, ids, side="right"), np.searchsorted(bounds, ids, side="left")
    rank = (turn.view(np.uint64) ^ np.uint64(1 << 63)).astype(np.float64) / 2.0**64
    within = np.minimum((rank * (behind - before)).astype(np.int64), np.maximum(behind - before - 1, 0))
    return len(bounds) - behind + within


def _own_partitions(spark: SparkSession, n: int) -> np.ndarray:
    """For each of ``n`` numbers a key that ``repartition(n, key)`` sends to the partition of that number."""
    keys = spark.range(0, 40 * n + 400).select(F.pmod(F.hash("id"), F.lit(n)).alias("p"), "id")
    found = {r["p"]: r["k"] for r in keys.groupBy("p").agg(F.min("id").alias("k")).collect()}
    return np.array([found.get(i, i) for i in range(n)], dtype=np.int64)


def with_next(docs: DataFrame) -> DataFrame:
    """``__key, __bucket, __tail, __id, text`` in sorted partitions: descending ids, equal ids by two hashes of the text, and
    behind the rows of each bucket, marked as tail, the row that follows them.

    The texts are shuffled once, one bucket to a partition. Bounds and the first row of each bucket are a few
    numbers per bucket. The row after the last is the first.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(order_key("doc_id").alias("__id"), F.xxhash64(text, F.lit(1)).alias("__h1"), F.xxhash64(text, F.lit(2)).alias("__h2"), text.alias("text"))
    bounds = _bounds(keyed, parts)
    own = _own_partitions(spark, parts)

    def order(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        ids, h1, h2 = (batch.column(c).to_numpy() for c in ("__id", "__h1", "__h2"))
        return _bucket(ids, h1, bounds), ~ids, h1, h2

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, *keys = order(batch)
            by = np.lexsort((*keys[::-1], bucket))
            by = by[np.diff(bucket[by], prepend=-1) != 0]
            yield pa.RecordBatch.from_arrays([pa.array(x[by]) for x in (bucket, *keys)], ["b", "i", "h1", "h2"])

    heads = keyed.drop("text").mapInArrow(first, "b long, i long, h1 long, h2 long").groupBy("b").agg(F.min(F.struct("i", "h1", "h2")).alias("first"))
    firsts = {r["b"]: tuple(r["first"]) for r in heads.collect()}
    there = sorted(firsts)
    before = {b: there[i - 1] for i, b in enumerate(there)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, *keys = order(batch)
            yield _dealt(batch, bucket, False, own)
            for b in np.unique(bucket).tolist():
                lead = np.flatnonzero((bucket == b) & np.all([k == v for k, v in zip(keys, firsts[b], strict=True)], axis=0))[:1]
                if len(lead):
                    yield _dealt(batch.take(pa.array(lead)), np.array([before[b]]), True, own)

    schema = "__key long, __bucket long, __tail boolean, __id long, __h1 long, __h2 long, text string"
    dealt = keyed.mapInArrow(deal, schema).repartition(parts, "__key")
    return dealt.sortWithinPartitions("__bucket", "__tail", F.desc("__id"), "__h1", "__h2").drop("__key", "__h1", "__h2")


def _dealt(batch: pa.RecordBatch, bucket: np.ndarray, tail: bool, own: np.ndarray) -> pa.RecordBatch:
    marks = [pa.array(own[bucket]), pa.array(bucket), pa.array(np.full(len(bucket), tail))]
    return pa.RecordBatch.from_arrays([*marks, *map(batch.column, ("__id", "__h1", "__h2", "text"))], ["__key", "__bucket", "__tail", "__id", "__h1", "__h2", "text"])


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)
#: Texts that are compared at a time: so many, or so many bytes.
_GROUP = 1024
_GROUP_BYTES = 8 << 20


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of each row, its edited text and the likeness to it and to the next row."""
    held: list[tuple[int, int, bool, str]] = []
    size = 0
    for batch in rows_of(batches, _GROUP_BYTES):
        for row in zip(*(batch.column(c).to_pylist() for c in ("__bucket", "__id", "__tail", "text")), strict=True):
            held.append(row)
            size += len(row[3])
            if len(held) > _GROUP or size > _GROUP_BYTES and len(held) > 1:
                yield _compared(held)
                held, size = held[-1:], len(row[3])
    if held:
        yield _compared(held)


def _compared(rows: list[tuple[int, int, bool, str]]) -> pa.RecordBatch:
    """Results of all rows but the last, which the next call gets again, and but tails."""
    own = sketches([text.encode() for *_, text in rows])
    at = [i for i in range(len(rows) - 1) if not rows[i][2]]
    edited = []
    for i in at:
        text, following = rows[i][3], rows[i + 1][3]
        half = len(text) // 2
        edited.append((text[: len(text) - half] + following[:half]).encode())
    other = sketches(edited)
    columns = [
        pa.array([None if rows[i][1] == NO_ID else rows[i][1] for i in at], pa.int64()),
        pa.array([len(rows[i][3]) for i in at], pa.int64()),
        pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
        pa.array([packed(own[i]) for i in at], pa.string()),
        pa.array([packed(x) for x in other], pa.string()),
        pa.array([likeness(own[i], x) for i, x in zip(at, other, strict=True)], pa.float64()),
        pa.array([likeness(own[i], own[i + 1]) for i in at], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in RESULT.split(", ")])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text (the last half of its code points replaced by as
    many of the next document's first), and its estimated likeness to the edited text and to the next document.

    Next: descending doc_id, equal ids by hashes of their texts, null ids last; after the last the first. A null
    text is empty. A single row is its own successor; an empty table gives no rows; other
    columns are ignored. Repeated rows give equal fingerprints.
    """
    return with_next(docs).mapInArrow(_compare, RESULT)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with a ``fingerprint`` column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            found = [packed(x) for x in sketches(text_bytes(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "fingerprint"])

    base = docs.drop("fingerprint")
    return base.mapInArrow(run, with_fields(base, "fingerprint string"))
