"""Substring dedup: every word covered by a 20-word window that also starts earlier goes.

The named method - suffix automata of reference shards, broadcast, and all documents streamed
past each - reads the corpus once per shard, so its work grows with the square of the corpus;
see the README for figures. ``automaton.py`` has it for a reference of bounded size. Here the
whole corpus is its own reference, and windows meet by content instead:

1. Within a slice of documents (bounded bytes, in id order) windows that start earlier in the
   slice are settled on the spot. This is also what keeps hot passages small: a slice passes on
   each window once.
2. A window's anchor is the smallest hash of its 16 five-word runs. Equal windows have equal anchors,
   and neighbouring windows mostly share one, so runs of windows travel together to the
   bucket of their anchor: eight bytes a window and a few a run. Anchors are counted first, every
   ``COUNT_STEP``-th window of each text, in counters of a fixed number; a window whose anchor
   is a hot one goes to a bucket by its own words instead, by a hash that has no part in the next step.
3. A bucket sorts its windows by their 64-bit hash; of equal ones all but the earliest are
   removed. Buckets are as many as it takes to hold about ``BUCKET_WINDOWS`` windows each. Different windows
   are taken for equal only if hash and bucket agree: W windows in B buckets, W * W / B / 2**65 of them in
   all, 0.6 at 2 * 10**13 windows (100 TB).
4. The removed window starts return to their documents, by (doc_id, checksum of the text).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import in_tasks, order_key, prefix, rows_of, squeezed, text_bytes, unsqueezed, with_fields
from .words import blocks, hashed_words, mix, runs

WINDOW = 20
#: Buckets of a task at most, on average.
TASK_BUCKETS = 4
ANCHOR = 5
BUCKET_WINDOWS = 1 << 20
SLICE_BYTES = 16 << 20
COUNT_STEP = 64
COUNTERS = 1 << 22
_MASK_RUN = 62
_KINDS = ["<u8", "<i8", "<u4", "<u4", "u1"]
_SETTLED = "doc long, crc long, start int, mask long"


def _sliding_min(h: np.ndarray, k: int) -> np.ndarray:
    """Minimum of each k neighbours (k a power of two), by doubling."""
    step = 1
    while step < k:
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return h


def _counter(anchor: np.ndarray) -> np.ndarray:
    return (anchor % np.uint64(COUNTERS)).astype(np.int64)


def _windows(texts: list[bytes], window: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, anchor, text number and start of all windows of ``texts``, in order. A window whose anchor is hot has another
    hash of its own words for one."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    for a, b in blocks(texts):
        _, _, h, first = hashed_words(texts[a:b])
        if len(h) < window:
            continue
        w5 = runs(h, ANCHOR)
        anchors = _sliding_min(w5, window - ANCHOR + 1)
        # a window's hash from four 5-word runs side by side
        n = len(h) - window + 1
        w = mix(w5[:n])
        for at in range(ANCHOR, window, ANCHOR):
            w = mix(w ^ w5[at : at + n]) + np.uint64(at)
        doc = np.repeat(np.arange(b - a), np.diff(first))
        inside = doc[:n] == doc[window - 1 :]
        doc = doc[:n][inside]
        if len(hot):
            at = np.flatnonzero(np.isin(_counter(anchors), hot))
            anchors[at] = w5[at] ^ mix(w5[at + window // 2] + np.uint64(window))
        found[0].append(w[inside])
        found[1].append(anchors[inside])
        found[2].append((doc + a).astype(np.int32))
        found[3].append((np.flatnonzero(inside) - first[doc]).astype(np.int32))
    if not found[0]:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    whole = []
    for x in found:
        whole.append(np.concatenate(x))
        x.clear()
    return tuple(whole)


def _masks(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start) pairs in order as (doc, first start, bit mask of the starts from there)."""
    if not len(doc):
        return doc, start, start
    cell = start // _MASK_RUN
    first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (cell[1:] != cell[:-1])]))
    bits = np.left_shift(np.int64(1), start - cell * _MASK_RUN)
    return doc[first], cell[first] * _MASK_RUN, np.bitwise_or.reduceat(bits, first)


def _count(window: int):
    """Texts in; the number of their windows (counter -1) and of every ``COUNT_STEP``-th one by anchor out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, SLICE_BYTES // 4):
            texts, total, seen = text_bytes(batch.column("text")), 0, []
            for a, b in blocks(texts):
                _, _, h, first = hashed_words(texts[a:b])
                if len(h) < window:
                    continue
                anchors = _sliding_min(runs(h, ANCHOR), window - ANCHOR + 1)
                size = np.maximum(np.diff(first) - window + 1, 0)
                total += int(size.sum())
                counted = -(-size // COUNT_STEP)
                nth = np.arange(counted.sum()) - np.repeat(np.cumsum(counted) - counted, counted)
                seen.append(_counter(anchors[np.repeat(first[:-1], counted) + nth * COUNT_STEP]))
            counter, n = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(np.append(counter, -1)), pa.array(np.append(n, total))], ["counter", "n"])

    return run


def _hot_anchors(keyed: DataFrame, window: int) -> tuple[int, np.ndarray]:
    """The number of windows, and the counters of the anchors that would fill a bucket: only so many as can be over the limit,
    an eighth of a bucket or sixteen times a counter's fair share."""
    counts = keyed.mapInArrow(_count(window), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    least = BUCKET_WINDOWS // 8
    found = counts.where((F.col("counter") < 0) | (F.col("n") * COUNT_STEP > least)).toArrow()  # COUNTERS rows at most
    counter, n = (found.column(c).to_numpy() for c in ("counter", "n"))
    total = int(n[counter < 0].sum())
    return total, np.sort(counter[(counter >= 0) & (n * COUNT_STEP > max(least, 16 * total // COUNTERS))])


def _settle(n_buckets: int, window: int, hot: np.ndarray):
    """Slices of documents in; rows with a blob for a bucket, or with starts already settled, out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, SLICE_BYTES):
            ids, crc = batch.column("doc").to_numpy(), batch.column("crc").to_numpy()
            order = np.argsort(ids, kind="stable")
            texts = text_bytes(batch.column("text").take(pa.array(order)))
            ids, crc = ids[order], crc[order]
            w, anchor, doc, start = _windows(texts, window, hot)
            del texts
            if not len(w):
                continue
            # windows stand by (id, start) but where rows share an id
            by = np.argsort(w, kind="stable") if (ids[1:] != ids[:-1]).all() else np.lexsort((start, ids[doc], w))
            ws = w[by]
            new = np.concatenate([[True], ws[1:] != ws[:-1]])
            first = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
            del ws
            earlier = (ids[doc[by]] != ids[doc[first]]) | (start[by] != start[first])
            late = np.sort(by[~new & earlier])
            # of rows that repeat an id and its text one goes on for all
            on = np.sort(by[new | (~earlier & (crc[doc[by]] != crc[doc[first]]))])
            yield _rows(np.array([-1 - int(ids[0]) % n_buckets]), [_settled(ids, crc, doc[late], start[late])])
            w, anchor, doc, start = w[on], anchor[on], doc[on], start[on]
            split = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)])
            head = np.flatnonzero(split)
            size = np.diff(head, append=len(w))
            bucket = (mix(anchor[head]) % np.uint64(n_buckets)).astype(np.int64)
            turn = np.argsort(bucket, kind="stable")
            head, size, bucket = head[turn], size[turn], bucket[turn]
            at = np.repeat(head - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(w))
            w = w[at]
            ends = np.cumsum(size)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            stop = np.append(cut[1:], len(bucket))
            found = []
            for a, b in zip(cut.tolist(), stop.tolist(), strict=True):
                h = head[a:b]
                long_runs = size[a:b]
                found.append(blobs.pack([
                    w[ends[a] - size[a] : ends[b - 1]], blobs.delta(ids[doc[h]]), crc[doc[h]].astype("<u4"),
                    start[h].astype("<u4"), np.minimum(long_runs, 255).astype("u1"),
                ]) if long_runs.max() < 256 else _long(w[ends[a] - size[a] : ends[b - 1]], ids[doc[h]], crc[doc[h]], start[h], long_runs))
            yield _rows(bucket[cut], found)

    return run


def _long(w: np.ndarray, ids: np.ndarray, crc: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """Runs of over 255 windows (texts that repeat themselves), cut into shorter ones."""
    pieces = -(-size // 255)
    which = np.repeat(np.arange(len(size)), pieces)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return blobs.pack([
        w, blobs.delta(ids[which]), crc[which].astype("<u4"), (start[which] + 255 * nth).astype("<u4"),
        np.minimum(size[which] - 255 * nth, 255).astype("u1"),
    ])


def _settled(ids: np.ndarray, crc: np.ndarray, doc: np.ndarray, start: np.ndarray) -> bytes:
    doc, first, mask = _masks(doc, start)
    return blobs.pack([ids[doc], crc[doc].astype("<i8"), first.astype("<i4"), mask.astype("<i8")])


def _rows(bucket: np.ndarray, found: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(found, pa.binary())], ["bucket", "blob"])


def _open_settled(rows: pa.Table) -> pa.Table:
    parts = [blobs.unpack(x, ["<i8", "<i8", "<i4", "<i8"]) for x in rows.column("blob").to_pylist()]
    return pa.table({name: np.concatenate([p[i] for p in parts]) for i, name in enumerate(("doc", "crc", "start", "mask"))})


def _meet(rows: pa.Table) -> pa.Table:
    """All windows of a bucket; of equal ones all but the earliest are settled. Negative buckets hold what slices settled."""
    if rows.column("bucket")[0].as_py() < 0:
        return _open_settled(rows)
    parts = [blobs.unpack(x, _KINDS) for x in rows.column("blob").to_pylist()]
    w = np.concatenate([p[0] for p in parts])
    ids, crc = np.concatenate([blobs.undelta(p[1]) for p in parts]), np.concatenate([p[2] for p in parts])
    start, size = np.concatenate([p[3] for p in parts]).astype(np.int64), np.concatenate([p[4] for p in parts]).astype(np.int64)
    del parts
    run = np.repeat(np.arange(len(size)), size)
    start = start[run] + np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size)
    by = np.argsort(w)
    ws = w[by]
    same = ws[1:] == ws[:-1]
    shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    by = by[shared]
    by = by[np.lexsort((start[by], ids[run[by]], w[by]))]
    new = np.concatenate([[True], w[by][1:] != w[by][:-1]]) if len(by) else np.zeros(0, bool)
    first = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))] if len(by) else by
    late = by[~new & ((ids[run[by]] != ids[run[first]]) | (start[by] != start[first]))]
    late = late[np.lexsort((start[late], crc[run[late]], ids[run[late]]))]
    number = np.cumsum(np.concatenate([[0], (ids[run[late]][1:] != ids[run[late]][:-1]) | (crc[run[late]][1:] != crc[run[late]][:-1])])) if len(late) else late
    doc, at, mask = _masks(number, start[late])
    head = np.searchsorted(number, doc)
    return pa.table({"doc": ids[run[late[head]]], "crc": crc[run[late[head]]].astype(np.int64), "start": at.astype(np.int32), "mask": mask.astype(np.int64)})


def repeated_windows(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc, crc, start, mask``: the windows of each document that also start earlier."""
    total, hot = _hot_anchors(keyed, window)
    n_buckets = max(16, math.ceil(total / BUCKET_WINDOWS))
    rows = keyed.mapInArrow(_settle(n_buckets, window, hot), "bucket long, blob binary")
    return in_tasks(rows, 2 * n_buckets, TASK_BUCKETS).groupBy("bucket").applyInArrow(_meet, _SETTLED)


def covered(n_words: int, cuts: list[dict], window: int = WINDOW) -> np.ndarray:
    """Which words lie in one of the windows of ``cuts`` (first start and bit mask)."""
    step = np.zeros(n_words + 1, dtype=np.int32)
    for cut in cuts:
        starts = cut["start"] + np.flatnonzero((cut["mask"] >> np.arange(_MASK_RUN)) & 1)
        step[starts] += 1
        step[starts + window] -= 1
    return np.cumsum(step[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``text`` cut down to the words that stay, joined by one blank, and ``n_words, n_removed``.

    A word goes if a ``window`` that covers it has the words of one that starts earlier: at a smaller doc_id
    (null: the smallest), or earlier in the same document. Windows are judged on the input. Null texts
    have no words and become empty; rows that repeat id and text are one document and get the same result;
    texts shorter than a window stay whole; an empty table gives no rows.
    """
    base = docs.drop("n_words", "n_removed")
    p = prefix(base)
    keys = {f"{p}doc": order_key("doc_id"), f"{p}crc": F.crc32(F.coalesce("text", F.lit("")).cast("binary"))}
    keyed = base.select(keys[f"{p}doc"].alias("doc"), keys[f"{p}crc"].alias("crc"), "text")
    cuts = repeated_windows(keyed, window).groupBy("doc", "crc").agg(F.collect_list(F.struct("start", "mask"))).toDF(*keys, f"{p}cuts")
    joined = squeezed(base.withColumns(keys)).join(cuts, list(keys), "left")
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, SLICE_BYTES // 2):
            texts, counts, gone = [], [], []
            for text, found in zip(unsqueezed(batch.column("text")), batch.column(f"{p}cuts").to_pylist(), strict=True):
                words = text.split()
                counts.append(len(words))
                if found:
                    keep = ~covered(len(words), found, window)
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                gone.append(counts[-1] - len(words))
                texts.append(b" ".join(words))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_words", "n_removed"])

    return joined.select(*names, f"{p}cuts").mapInArrow(run, with_fields(base, "n_words long, n_removed long"))
