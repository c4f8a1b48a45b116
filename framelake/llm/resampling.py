"""Importance resampling towards a target distribution.

The sparse document-by-bucket count matrix is written once, as blocks of rows in compressed sparse row form. Its column sums
and those of the target give each bucket a gain; the product of the matrix with the gains gives each document's
weight. Exponential noise from a hash of the id turns the weights into scores whose highest are a draw
without replacement.

A word is a run of 0-9, a-z (after A-Z were lowered) and bytes from 0x80. Features are runs of 1 to 3 words, joined by a blank; a feature's bucket
is its crc32 modulo ``BUCKETS``. Checksums of runs are put together from those of words: the checksum is
linear, so appending n bytes is one table look-up a byte of the state, whatever n.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import blobs, words
from .common import rows_of, saved, text_bytes

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = "42"
BLOCK_DOCS = 4096
_NEAR = 64  # lengths with a table of their own
_FLIP = np.uint32(0xFFFFFFFF)
_LOW = np.uint32(0xFF)
_BLANK = 0x20
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _byte_table() -> np.ndarray:
    """The table of the reflected polynomial 0xEDB88320."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> np.uint32(1)), c >> np.uint32(1))
    return c


_BYTE = _byte_table()


def _look_up(tables: np.ndarray, at: np.ndarray, c: np.ndarray) -> np.ndarray:
    found = tables[at, 0, c & _LOW]
    for k in range(1, 4):
        found = found ^ tables[at, k, (c >> np.uint32(8 * k)) & _LOW]
    return found


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """What n zero bytes make of each byte of a state: for n below ``_NEAR``, and for n = 2 ** k."""
    near = np.empty((_NEAR, 4, 256), dtype=np.uint32)
    near[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(1, _NEAR):
        near[n] = _BYTE[near[n - 1] & _LOW] ^ (near[n - 1] >> np.uint32(8))
    powers = np.empty((48, 4, 256), dtype=np.uint32)
    powers[0] = near[1]
    for k in range(1, len(powers)):
        powers[k] = _look_up(powers[k - 1][None], np.zeros(1, np.int64), powers[k - 1])
    return near, powers


_NEAR_SHIFT, _POWER_SHIFT = _shift_tables()


def _shifted(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The checksums ``c`` as they count once ``n`` more bytes follow."""
    out = _look_up(_NEAR_SHIFT, np.minimum(n, _NEAR - 1), c)
    far = np.flatnonzero(n >= _NEAR)
    if len(far):
        state, left = c[far], n[far]
        for k in range(int(left.max()).bit_length()):
            state = np.where(left >> k & 1, _look_up(_POWER_SHIFT, np.full(len(state), k), state), state)
        out[far] = state
    return out


def _blank_after(c: np.ndarray) -> np.ndarray:
    c = c ^ _FLIP
    return (_BYTE[(c ^ np.uint32(_BLANK)) & _LOW] ^ (c >> np.uint32(8))) ^ _FLIP


def _word_checksums(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = np.full(len(start), _FLIP, dtype=np.uint32)
    order = np.argsort(-np.minimum(size, _NEAR), kind="stable")
    first, n = start[order], size[order]
    near = np.flatnonzero(n < _NEAR)[0] if (n < _NEAR).any() else len(n)
    first, n, order_near = first[near:], n[near:], order[near:]
    c = np.full(len(n), _FLIP, dtype=np.uint32)
    longer = np.searchsorted(-n, -np.arange(1, _NEAR), "right")  # words of at least k bytes stand first
    for k in range(int(n[0]) if len(n) else 0):
        m = longer[k]
        c[:m] = _BYTE[(c[:m] ^ buf[first[:m] + k]) & _LOW] ^ (c[:m] >> np.uint32(8))
    out[order_near] = c ^ _FLIP
    for i in order[:near].tolist():
        out[i] = zlib.crc32(buf[start[i] : start[i] + size[i]])
    return out


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner (the text's place) and bucket of every feature of ``texts``, and the number of words of each."""
    buf = np.frombuffer(b" ".join(t.lower() for t in texts), dtype=np.uint8)
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = _IN_WORD[buf]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    size = end - start
    begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    n_words = np.diff(np.searchsorted(start, begins))
    owner = np.repeat(np.arange(len(texts)), n_words)
    one = _word_checksums(buf, start, size)
    owners, sums, run = [owner], [one], one
    for k in (1, 2):
        together = owner[k:] == owner[:-k]
        run = _shifted(_blank_after(run[: len(one) - k]), size[k:]) ^ one[k:] if len(one) > k else run[:0]
        owners.append(owner[k:][together])
        sums.append(run[together])
    return np.concatenate(owners), (np.concatenate(sums) % np.uint32(BUCKETS)).astype(np.int64), n_words


def _blocks(table: DataFrame, key: str) -> DataFrame:
    """The count matrix of ``table`` in row blocks: ``ids, n_words, csr`` (row lengths, column gaps and counts, compressed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in rows_of(batches, 8 << 20):
            texts = text_bytes(batch.column("text"))
            ids = batch.column("id")
            for low, high in words.blocks(texts):
                for a in range(low, high, BLOCK_DOCS):
                    b = min(high, a + BLOCK_DOCS)
                    owner, bucket, n_words = features(texts[a:b])
                    cells, counts = np.unique(owner * BUCKETS + bucket, return_counts=True)
                    row, column = cells // BUCKETS, cells % BUCKETS
                    gap = np.diff(column, prepend=0)
                    fresh = np.flatnonzero(np.diff(row, prepend=-1))
                    gap[fresh] = column[fresh]
                    lengths = np.bincount(row, minlength=b - a)
                    csr = press.compress(blobs.pack([lengths.astype("<u4"), gap.astype("<u2"), counts.astype("<u4")]))
                    per_row = lambda v, kind: pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), pa.array(v, kind))  # noqa: E731, B023
                    id_list = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), ids.slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([id_list, per_row(n_words, pa.int64()), pa.array([csr], pa.binary())], ["ids", "n_words", "csr"])

    return table.select(F.col(key).cast("long").alias("id"), "text").mapInArrow(run, "ids array<long>, n_words array<long>, csr binary")


def _unpacked(frame: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row starts (one more than rows), columns and counts of a block."""
    lengths, gap, counts = blobs.unpack(zstandard.ZstdDecompressor().decompress(frame), ["<u4", "<u2", "<u4"])
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    total = np.cumsum(gap, dtype=np.int64)
    before = np.concatenate([[0], total])[starts[:-1]]
    return starts, total - np.repeat(before, lengths), counts.astype(np.int64)


def column_sums(blocks: DataFrame) -> np.ndarray:
    """The sum of each of the ``BUCKETS`` columns: dense within a task, then one row a task and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for frame in batch.column("csr").to_pylist():
                _, column, counts = _unpacked(frame)
                sums += np.bincount(column, counts, BUCKETS).astype(np.int64)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(sums[at])], ["bucket", "n"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    for bucket, n in blocks.select("csr").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) for each bucket."""
    every_s, every_t = int(source.sum()) + len(source), int(target.sum()) + len(target)
    ratio = [float((t + 1) * every_s) / float((s + 1) * every_t) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def weighed(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the product of the matrix with ``gain``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, frame in enumerate(batch.column("csr").to_pylist()):
                starts, column, counts = _unpacked(frame)
                n = np.diff(np.concatenate([[0], np.cumsum(counts)])[starts])
                weight = np.diff(np.concatenate([[0], np.cumsum(gain[column] * counts)])[starts])
                columns = [batch.column("ids")[i].values, batch.column("n_words")[i].values, pa.array(n), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def _noise():
    """floor(-1000 ln(-ln u)), u from the first 32 bits of the id's SHA-256."""
    text = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """``row, rank`` of the ``drawn`` highest scores (ties: the smaller id, null last): rows in order by ranges, a rank from
    the rows of the ranges before."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    ranges = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lined = saved(scored.select("score", "doc_id", "row").repartitionByRange(ranges, *order).sortWithinPartitions(*order))
    placed = lined.select("row", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    sizes = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    starts = F.broadcast(sizes.select("range", before.alias("before")))
    return placed.join(starts, "range").select("row", (F.col("before") + F.col("at") + 1).alias("rank")).where(F.col("rank") <= drawn)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs`` (``doc_id, text``), drawn towards ``target`` (``text``).

    rank counts the drawn ``percent`` of the documents of ``least_words`` or more, best first, and is null for others. A null or
    wordless text has no features and a weight of 0; a null id is hashed as an empty one and loses ties; rows that
    repeat are ranked one by one. Either table may be empty; other columns are ignored.
    """
    blocks = saved(_blocks(docs, "doc_id"))
    other = _blocks(target.select(F.lit(0).alias("doc_id"), "text"), "doc_id")
    gain = gains(column_sums(blocks), column_sums(other))
    scored = saved(weighed(blocks, gain).withColumn("score", F.col("weight") + _noise())).withColumn("row", F.monotonically_increasing_id())
    able = scored.where(F.col("n_words") >= least_words)
    ranks = _ranked(able, able.count() * percent // 100)
    return scored.join(ranks, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")
