"""Hard negatives by norm-bucketed search.

Rows are sorted by norm, longest first, and cut into buckets (ranges) of blocks. A bucket is read block by block with the k best of each anchor so far. By
Cauchy-Schwarz no score in a block exceeds the anchor's norm times the longest in the block: an anchor is left out of a block where that
lies below its running k-th score (or, for a window of negatives, below the window's lower limit), and a bucket ends where all anchors are
out. Anchors come in lots of bounded size, which are broadcast; rows stay where they are, and only the k best of
each bucket are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
BUCKET_ROWS = 8192
BLOCK_ROWS = 1024
LOT_ANCHORS = 4096
LOT_BYTES = 64 << 20
_LEAST = np.iinfo(np.int64).min
_BLOCK = "top double, dims int, kind string, ids array<long>, labels array<long>, vectors binary"


@dataclass
class Block:
    """Rows of a bucket (or anchors): ids (masked where null), labels, components and norms."""

    ids: np.ndarray
    null: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    rows: np.ndarray

    def take(self, at: np.ndarray) -> Block:
        return Block(self.ids[at], self.null[at], self.labels[at], self.vectors[at], self.norms[at], self.rows[at])


def _components(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Floored components of all vectors one after another, the first of each (and an end), and which vectors are whole."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(size)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    with np.errstate(over="ignore", invalid="ignore"):
        return np.floor(SCALE * x), starts, bad[starts[1:]] == bad[starts[:-1]]


def _quantised(rows: DataFrame, label: Column) -> DataFrame:
    """``vec_id, label, norm, dims, q`` of the rows that take part; ``q``: components as doubles, or as 16 bits where they fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, starts, whole = _components(batch.column("embedding"))
            at = np.flatnonzero(whole)
            parts = [x[starts[i] : starts[i + 1]] for i in at.tolist()]
            norms = [float(np.sqrt(np.dot(v, v))) for v in parts]
            q = [v.astype("<i2").tobytes() if not len(v) or np.abs(v).max() < 1 << 15 else v.astype("<f8").tobytes() for v in parts]
            taken = batch.take(pa.array(at))
            columns = [taken.column("vec_id"), taken.column("label"), pa.array(norms, pa.float64()), pa.array([len(v) for v in parts], pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(q, pa.binary())], ["vec_id", "label", "norm", "dims", "q"])

    there = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull())
    slim = there.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return slim.mapInArrow(run, "vec_id long, label long, norm double, dims int, q binary")


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One block row of the rows of ``batch``; shorter vectors are filled up with zeros."""
    q, dims = batch.column("q").to_pylist(), batch.column("dims").to_pylist()
    parts = [np.frombuffer(v, dtype="<i2" if len(v) == 2 * d else "<f8") for v, d in zip(q, dims, strict=True)]
    width = max(dims)
    kind = "<i2" if all(v.dtype == np.dtype("<i2") for v in parts) else "<f8"
    whole = np.zeros((len(parts), width), dtype=kind)
    for i, v in enumerate(parts):
        whole[i, : len(v)] = v
    one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), batch.column(c))
    top = max(batch.column("norm").to_pylist())
    columns = [pa.array([top]), pa.array([width], pa.int32()), pa.array([kind]), one("vec_id"), one("label"), pa.array([whole.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["top", "dims", "kind", "ids", "labels", "vectors"])


def _unpacked(row: dict) -> Block:
    n = len(row["ids"])
    vectors = np.frombuffer(row["vectors"], dtype=row["kind"]).reshape(n, row["dims"]).astype(np.float64)
    null = np.array([x is None for x in row["ids"]], dtype=bool)
    ids = np.array([0 if x is None else x for x in row["ids"]], dtype=np.int64)
    rows = (row["block"] << 10) + np.arange(n)
    with np.errstate(over="ignore"):
        norms = np.sqrt((vectors * vectors).sum(axis=1))
    return Block(ids, null, np.array(row["labels"], dtype=np.int64), vectors, norms, rows)


def buckets(rows: DataFrame, label: Column) -> DataFrame:
    """Blocks of at most ``BLOCK_ROWS`` rows, longest first within each bucket (a partition), and a number for each; saved."""
    flat = saved(_quantised(rows, label))
    n = max(1, -(-flat.count() // BUCKET_ROWS))
    order = [F.col("norm").desc(), F.col("vec_id").asc_nulls_last()]
    dealt = flat.repartitionByRange(n, *order, F.xxhash64("q")).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                yield _packed(batch.slice(at, BLOCK_ROWS))

    return saved(dealt.mapInArrow(run, _BLOCK)).withColumn("block", F.monotonically_increasing_id())


def scores(a: Block, b: Block) -> np.ndarray:
    """Inner products. They are exact where both norms lie below 2 ** 31 (or their product below 2 ** 53); others are rounded as doubles and held within a long."""
    width = max(a.vectors.shape[1], b.vectors.shape[1])
    x, y = (np.pad(v.vectors, ((0, 0), (0, width - v.vectors.shape[1]))) if v.vectors.shape[1] < width else v.vectors for v in (a, b))
    with np.errstate(over="ignore", invalid="ignore"):
        found = x @ y.T
    largest = a.norms.max(initial=0) * b.norms.max(initial=0)
    if largest < 1 << 53:
        return found.astype(np.int64)
    out = np.clip(np.nan_to_num(found), -(2.0**62), 2.0**62).astype(np.int64)
    i, j = np.flatnonzero(a.norms < 1 << 31), np.flatnonzero(b.norms < 1 << 31)
    out[np.ix_(i, j)] = x[i].astype(np.int64) @ y[j].astype(np.int64).T
    return out


class _Best:
    """The k best (score, id) of each of n searches: higher scores first, then smaller ids, null last."""

    def __init__(self, n: int, k: int) -> None:
        self.n, self.k = n, k
        self.found = [np.empty(0, np.int64) for _ in range(5)]  # search, score, id, null, row
        self.limit = np.full(n, _LEAST)  # the k-th score, once there are k

    def add(self, search: np.ndarray, score: np.ndarray, block: Block, at: np.ndarray) -> None:
        if not len(search):
            return
        more = [search, score, block.ids[at], block.null[at].astype(np.int64), block.rows[at]]
        every = [np.concatenate(x) for x in zip(self.found, more, strict=True)]
        order = np.lexsort((every[4], every[2], every[3], -every[1], every[0]))
        by = every[0][order]
        place = np.arange(len(by)) - np.searchsorted(by, by)
        self.found = [x[order][place < self.k] for x in every]
        last = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.limit[self.found[0][last]] = self.found[1][last]


def _reach(norms: np.ndarray, top: float) -> np.ndarray:
    """No score is above this, rounding included."""
    return norms * top * (1 + 1e-9) + 1


def _search(blocks: DataFrame, lot: Block, windows: np.ndarray | None) -> DataFrame:
    """``search, score, id, row`` of the best in each bucket: rows of the anchors' own labels (a search an anchor), or, with
    ``windows`` (anchor, lowest, highest), rows of other labels between the limits (a search a window)."""
    shared = blocks.sparkSession.sparkContext.broadcast((lot, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, windows = shared.value
        best = _Best(len(lot.ids), POSITIVES) if windows is None else _Best(len(windows), NEGATIVES)
        for batch in batches:
            for row in batch.to_pylist():
                if windows is None:
                    lowest = best.limit
                else:
                    lowest = np.full(len(lot.ids), np.iinfo(np.int64).max)
                    np.minimum.at(lowest, windows[:, 0], np.maximum(windows[:, 1], best.limit))
                active = np.flatnonzero(_reach(lot.norms, row["top"]) >= lowest)
                if len(active):
                    block, few = _unpacked(row), lot.take(active)
                    _compare(best, few, active, block, lowest[active], windows)
        columns = [pa.array(best.found[i]) for i in (0, 1)]
        ids = pa.array(best.found[2], mask=best.found[3].astype(bool))
        yield pa.RecordBatch.from_arrays([*columns, ids, pa.array(best.found[4])], ["search", "score", "id", "row"])

    return blocks.mapInArrow(run, "search long, score long, id long, row long")


def _compare(best: _Best, few: Block, active: np.ndarray, block: Block, lowest: np.ndarray, windows: np.ndarray | None) -> None:
    """Take what a block has for the ``active`` anchors."""
    found = scores(few, block)
    same = few.labels[:, None] == block.labels[None, :]
    if windows is None:
        able = same & (few.rows[:, None] != block.rows[None, :])
        if found.shape[1] > best.k:  # at least k rows of the block lie at or above its own k-th
            kth = np.partition(np.where(able, found, _LEAST), -best.k, axis=1)[:, -best.k]
            lowest = np.maximum(lowest, kth)
        a, at = np.nonzero(able & (found >= lowest[:, None]))
        best.add(active[a], found[a, at], block, at)
        return
    a, at = np.nonzero(~same & (found >= lowest[:, None]))
    score = found[a, at]
    first = np.searchsorted(windows[:, 0], active[a])  # windows stand in order of anchors
    n = np.searchsorted(windows[:, 0], active[a], "right") - first
    pair = np.repeat(np.arange(len(a)), n)
    search = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else first
    inside = (score[pair] >= np.maximum(windows[search, 1], best.limit[search])) & (score[pair] <= windows[search, 2])
    best.add(search[inside], score[pair][inside], block, at[pair][inside])


def _first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each search over all buckets, with their ``rank``."""
    order = Window.partitionBy("search").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _lots(blocks: DataFrame, every: int) -> Iterator[Block]:
    """Anchors in lots of at most ``LOT_ANCHORS`` (fewer of wide vectors), read from the executors lot by lot."""
    own = F.filter(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.get("ids", i) % every == 0)
    few = blocks.where(F.exists("ids", lambda x: x % every == 0)).withColumn("at", own)
    held: list[Block] = []
    size = 0
    for row in few.toLocalIterator():
        part = _unpacked(row.asDict()).take(np.array(row["at"], dtype=np.int64))
        wide = part.vectors.shape[1] * 8
        if held and (size + len(part.ids) > LOT_ANCHORS or (size + len(part.ids)) * wide > LOT_BYTES):
            yield _joined(held)
            held, size = [], 0
        held.append(part)
        size += len(part.ids)
    if held:
        yield _joined(held)


def _joined(parts: list[Block]) -> Block:
    width = max(p.vectors.shape[1] for p in parts)
    vectors = [np.pad(p.vectors, ((0, 0), (0, width - p.vectors.shape[1]))) for p in parts]
    rest = [np.concatenate([getattr(p, c) for p in parts]) for c in ("ids", "null", "labels")]
    return Block(*rest, np.concatenate(vectors), *(np.concatenate([getattr(p, c) for p in parts]) for c in ("norms", "rows")))


def _mined(blocks: DataFrame, lot: Block) -> DataFrame:
    """Hard negatives of the anchors of ``lot``."""
    spark = blocks.sparkSession
    positives = _first(_search(blocks, lot, None), POSITIVES).orderBy("search", "rank").collect()  # at most POSITIVES an anchor
    windows = np.array([(r["search"], -(-80 * r["score"] // 100), r["score"]) for r in positives], dtype=np.int64).reshape(-1, 3)
    asked = [(i, int(lot.ids[r["search"]]), r["id"], r["score"]) for i, r in enumerate(positives)]
    names = spark.createDataFrame(asked, "search long, anchor_id long, positive_id long, positive_score long")
    found = _first(_search(blocks, lot, windows), NEGATIVES).join(F.broadcast(names), "search")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(rows: DataFrame, label: Column | None = None, every: int = 100) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of ``rows`` (``vec_id, embedding, label``; others
    are ignored) whose vec_id is divisible by ``every``: to each anchor and each of its first positives (rows of its label), the
    first rows of other labels with a score of 80 to 100 hundredths of the positive's.

    ``label`` may replace the column. Rows with a null label or vector, or a null, infinite or undefined component, take no part. A null
    vec_id is no anchor and loses ties; rows that repeat an id are rows of their own (the anchor's own row is left out, not its
    copies); shorter vectors count as filled up with zeros. An empty table gives no rows.
    """
    blocks = buckets(rows, F.col("label") if label is None else label)
    out = None
    for lot in _lots(blocks, every):
        mined = saved(_mined(blocks, lot))
        out = mined if out is None else out.unionByName(mined)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return rows.sparkSession.createDataFrame([], empty) if out is None else out


def shifted_labels() -> Column:
    """The label, moved on by one (modulo 10) where vec_id is divisible by 7."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
