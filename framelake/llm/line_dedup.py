"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct words, A-Z in lower case. A line goes if an earlier line
(smaller doc_id, or same document and smaller line number) has a Jaccard similarity of at least
``THRESHOLD`` with it; lines are judged on the input.

1. Rarity. Word hashes are counted in ``RARITY_BUCKETS`` counters - a table of fixed size, whatever
   the corpus - and tokens are ordered by (counter, hash): a total order, rarest first. Words
   that share a counter only look more frequent; every order gives exact results.
2. Prefixes. Similar lines share one of the first n - ceil(t n) + 1 tokens. Each slice of documents
   first settles lines whose token sets equal an earlier one in the slice, then sends one
   compact entry (token, size, position, 64-bit parity of the token set, 128 bits for long lines, place) for each
   prefix token to the bucket of the token.
3. Candidates. Within a token, a pair must fit in size, in what is left behind the matching
   position, and in its parities: tokens that only one line has toggle bits, so the differing bits
   never exceed the symmetric difference. For each line the ``TOKEN_PARTNERS`` closest earlier partners of a token are passed
   on, of all tokens the ``FIRST_PARTNERS`` closest, and whether there were more; so a group of mutual near copies gives a
   few rows a line, not all pairs.
   In a token of over ``HOT_ENTRIES`` entries each line is held against the ``PIVOTS`` earliest first, and only lines without a
   partner among these against the others, so a large group of near copies costs a few comparisons a line.
   Equal token sets (by two 64-bit sums over full word hashes) meet in buckets of their own and need no more;
   so do lines too short to have a similar one of another set.
4. Verification of the others on the words themselves: asked lines are fetched from their documents, joined to the pairs
   as rows, and compared by array functions. Lines of which all these partners fail and that had more are tried against all
   their partners in a second round, for which only the entries go out whose token one of these lines has (told by a
   bitmap of fixed size).

Documents are dealt by id and checksum once, as zstandard frames, and saved so; a bucket holds a
bounded number of entries on average.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import in_tasks, order_key, partitions, prefix, rows_of, saved, squeezed, text_bytes, unsqueezed, with_fields
from .words import blocks, hashed_words, mix

THRESHOLD = 0.8
RARITY_BUCKETS = 1 << 18
BUCKET_ENTRIES = 1 << 17
#: Buckets of a task at most, on average.
TASK_BUCKETS = 12
SLICE_BYTES = 12 << 20
#: Partners of a line that a token passes on, and that are verified in the first round.
TOKEN_PARTNERS = 4
FIRST_PARTNERS = 4
#: Slots of the bitmap of tokens that the second round asks for.
TOKEN_SLOTS = 1 << 22
#: Tokens from which a line has a second parity word; for others it is 0, which compresses away.
WIDE_LINE = 48
#: Entries from which a token's lines are held against ``PIVOTS`` of them first.
HOT_ENTRIES = 512
PIVOTS = 32
#: Entries that a bucket compares at a time.
_PAIRS = 1 << 19
_KINDS = ["<u4", "<u4", "<u4", "<u8", "<u8", "<i8", "<u4", "<u4", "u1"]
_FOUND = "x_doc long, x_crc long, x_line int, y_doc long, y_crc long, y_line int, more boolean, sure boolean, apart int"
_SAME = ["<u8", "<u8", "<i8", "<u4", "<u4"]
_EPS = 1e-9
_SECOND = np.uint64(0xA0761D6478BD642F)


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - RARITY_BUCKETS.bit_length() + 1)).astype(np.int64)


#: Counters that travel as one value.
_COUNTER_BLOCK = 4096


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(RARITY_BUCKETS, dtype=np.int64)
    for batch in rows_of(batches):
        texts = [x.lower() for x in text_bytes(batch.column("text"))]
        for a, b in blocks(texts):
            counts += np.bincount(_counter(hashed_words(texts[a:b])[2]), minlength=RARITY_BUCKETS)
    if counts.any():
        parts = [blobs.pack([x]) for x in counts.reshape(-1, _COUNTER_BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["block", "counts"])


def _added(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a block, added up batch by batch."""
    block, total = 0, np.zeros(_COUNTER_BLOCK, dtype=np.int64)
    for batch in rows:
        block = batch.column("block")[0].as_py()
        for x in batch.column("counts"):
            total += blobs.unpack(x.as_py(), ["<i8"])[0]
    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([blobs.pack([total])], pa.binary())], ["block", "counts"])


def rarity(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The order of the counters (log scale, in 12 bits) and the number of words. The driver gets the fixed-size table."""
    schema = "block int, counts binary"
    counts = np.zeros((RARITY_BUCKETS // _COUNTER_BLOCK, _COUNTER_BLOCK), dtype=np.int64)
    found = docs.select("text").mapInArrow(_count, schema).groupBy("block").applyInArrow(_added, schema).toArrow()
    for block, blob in zip(found.column("block").to_pylist(), found.column("counts").to_pylist(), strict=True):
        counts[block] = blobs.unpack(blob, ["<i8"])[0]
    return (np.log2(counts.ravel() + 1) * 64).astype(np.uint64), int(counts.sum())


def prefix_length(n: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Tokens of a prefix; none for sizes that only an equal set is similar to (n of n + 1 words in common are too few)."""
    return np.where(n < threshold * (n + 1) - _EPS, 0, n - np.ceil(threshold * n - _EPS).astype(n.dtype) + 1)


def _in_lines(which: np.ndarray, rank: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order of words by line, rank (of 12 bits) and hash. One key of line, rank and half of the hash does in nearly all blocks."""
    if which[-1] < 1 << 20:
        key = (which.astype(np.uint64) << np.uint64(44)) | (rank << np.uint64(32)) | (h >> np.uint64(32))
        by = np.argsort(key)
        key, h = key[by], h[by]
        if not ((key[1:] == key[:-1]) & (h[1:] != h[:-1])).any():
            return by
        h = h[np.argsort(by)]
    return np.lexsort((h, rank, which))


class _Lines:
    """Token sets of the lines of some texts, in order; lines without words are left out, and those without a word of
    the slots ``asked``."""

    def __init__(self, texts: list[bytes], order: np.ndarray, asked: np.ndarray | None = None):
        token, line_of, doc, number, identity, second = [], [], [], [], [], []
        base = 0
        for a, b in blocks(texts):
            low, at = [x.lower() for x in texts[a:b]], np.arange(a, b)
            buf, start, h, first = hashed_words(low)
            if not len(h):
                continue
            breaks = np.concatenate([[0], np.cumsum(buf == 10, dtype=np.int32)])
            length = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
            begin = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
            text = np.repeat(np.arange(len(low)), np.diff(first))
            if asked is not None:  # only texts with an asked word go on
                hit = asked[_slot(mix(h))]
                hits = np.concatenate([[0], np.cumsum(hit)])
                words = (hits[first[1:]] > hits[first[:-1]])[text]
                start, h, text, hit = start[words], h[words], text[words], hit[words]
                if not len(h):
                    continue
            line = breaks[start] - breaks[begin][text]
            new = np.concatenate([[True], (line[1:] != line[:-1]) | (text[1:] != text[:-1])])
            which = np.cumsum(new) - 1
            if asked is not None:
                some = np.zeros(which[-1] + 1, dtype=bool)
                some[which[hit]] = True
                words = some[which]
                h, text, line = h[words], text[words], line[words]
                new = np.concatenate([[True], (line[1:] != line[:-1]) | (text[1:] != text[:-1])])
                which = np.cumsum(new) - 1
            by = _in_lines(which, order[_counter(h)], h)
            which, h = which[by], h[by]
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (which[1:] != which[:-1])])
            which, h = which[once], h[once]
            token.append(h)
            line_of.append(which + base)
            ends = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            mixed = mix(h)
            identity.append(np.add.reduceat(mixed, ends))
            second.append(np.add.reduceat(mix(mixed ^ _SECOND), ends))
            head = np.flatnonzero(new)
            doc.append(at[text[head]])
            number.append(line[head])
            base += len(head)
        self.token = np.concatenate(token) if token else np.zeros(0, np.uint64)
        line_of = np.concatenate(line_of) if line_of else np.zeros(0, np.int64)
        self.doc = np.concatenate(doc) if doc else np.zeros(0, np.int64)
        self.number = np.concatenate(number).astype(np.int64) if number else np.zeros(0, np.int64)
        self.size = np.bincount(line_of, minlength=base)
        self.first = np.cumsum(self.size) - self.size
        mixed = mix(self.token)
        self.identity = np.concatenate(identity) if identity else mixed
        self.second = np.concatenate(second) if second else mixed
        # seven bits of a token choose one of 128 bits: the low word's, or the high word's
        bit, high = np.uint64(1) << (mixed & np.uint64(63)), (mixed & np.uint64(64)) > 0
        wide = np.repeat(self.size >= WIDE_LINE, self.size)
        none = np.uint64(0)
        self.parity = np.bitwise_xor.reduceat(np.where(wide & high, none, bit), self.first) if base else mixed
        self.parity_high = np.bitwise_xor.reduceat(np.where(wide & high, bit, none), self.first) if base else mixed


def _prefixes(lines: _Lines, on: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, position and token of the prefix tokens of the lines that are ``on``."""
    count = np.where(on, prefix_length(lines.size, threshold), 0)
    line = np.repeat(np.arange(len(on)), count)
    position = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
    return line, position, mix(lines.token[lines.first[line] + position])


def _slot(token: np.ndarray) -> np.ndarray:
    return (token & np.uint64(TOKEN_SLOTS - 1)).astype(np.int64)


def _entries(lines: _Lines, on: np.ndarray, ids: np.ndarray, crc: np.ndarray, number: np.ndarray, probe: int, n_buckets: int, threshold: float, asked: np.ndarray | None):
    """A blob of entries for each bucket; ``asked``: the slots outside of which no entry goes."""
    line, position, token = _prefixes(lines, on, threshold)
    if asked is not None:
        wanted = asked[_slot(token)]
        line, position, token = line[wanted], position[wanted], token[wanted]
    bucket = (mix(token) % np.uint64(n_buckets)).astype(np.int64)
    turn = np.argsort(bucket, kind="stable")
    line, position, token, bucket = line[turn], position[turn], token[turn], bucket[turn]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    found = []
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(bucket)).tolist(), strict=len(cut) > 0):
        x = line[a:b]
        d = lines.doc[x]
        found.append(blobs.pack([
            (token[a:b] >> np.uint64(32)).astype("<u4"), lines.size[x].astype("<u4"), position[a:b].astype("<u4"), lines.parity[x], lines.parity_high[x],
            blobs.delta(ids[d]), crc[d].astype("<u4"), number[x].astype("<u4"), np.full(b - a, probe, dtype="u1"),
        ]))
    return _rows(bucket[cut], found)


def _same_sets(lines: _Lines, on: np.ndarray, ids: np.ndarray, crc: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """One entry a line for the buckets of whole token sets, which stand behind those of tokens."""
    bucket = (mix(lines.identity[on]) % np.uint64(n_buckets)).astype(np.int64)
    turn = np.argsort(bucket, kind="stable")
    on, bucket = on[turn], bucket[turn]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    found = []
    for x in np.split(on, cut[1:]):
        d = lines.doc[x]
        found.append(blobs.pack([lines.identity[x], lines.second[x], blobs.delta(ids[d]), crc[d].astype("<u4"), lines.number[x].astype("<u4")]))
    return _rows(bucket[cut] + n_buckets, found)


def _firsts(by: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each place the first one, in the order ``by``, that has the same keys."""
    new = np.concatenate([[True], np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)])
    out = np.empty(len(by), dtype=np.int64)
    out[by] = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    return out


def _emit(order: np.ndarray, n_buckets: int, threshold: float, asked: np.ndarray | None = None):
    """Slices of documents in, blobs of entries out; in the first round (``asked`` is None) also what slices settle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = None if asked is None else np.unpackbits(asked).astype(bool)
        for batch in rows_of(batches, SLICE_BYTES):
            ids, crc = batch.column("doc").to_numpy(), batch.column("crc").to_numpy()
            turn = np.argsort(ids, kind="stable")
            texts = text_bytes(batch.column("text").take(pa.array(turn)))
            ids, crc = ids[turn], crc[turn]
            lines = _Lines(texts, order, slots)
            del texts
            if not len(lines.size):
                continue
            place = np.arange(len(lines.size))
            rep = _firsts(np.lexsort((place, lines.second, lines.identity)), lines.identity, lines.second)
            earlier = (ids[lines.doc] != ids[lines.doc[rep]]) | (lines.number != lines.number[rep])
            late = np.flatnonzero((rep != place) & earlier)
            on = (rep == place) | ((rep != place) & ~earlier & (crc[lines.doc] != crc[lines.doc[rep]]))
            if asked is None:
                yield _rows(
                    np.array([-1 - int(ids[0]) % n_buckets]),
                    [blobs.pack([ids[lines.doc[late]], crc[lines.doc[late]], lines.number[late], ids[lines.doc[rep[late]]], crc[lines.doc[rep[late]]], lines.number[rep[late]]])],
                )
                yield _same_sets(lines, np.flatnonzero(on), ids, crc, n_buckets)
            yield _entries(lines, on, ids, crc, lines.number, 0, n_buckets, threshold, slots)

    return run


def _probes(order: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Lines, np.ndarray, pa.RecordBatch]]:
    """Lines that ask again (one a row), all of them on."""
    for batch in rows_of(batches):
        lines = _Lines(text_bytes(batch.column("x_text")), order)
        if len(lines.size):
            yield lines, np.ones(len(lines.size), dtype=bool), batch


def _ask(order: np.ndarray, n_buckets: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, on, batch in _probes(order, batches):
            ids, crc, number = (batch.column(k).to_numpy() for k in ("doc", "crc", "line"))
            yield _entries(lines, on, ids, crc, number[lines.doc], 1, n_buckets, threshold, None)

    return run


def _asked(order: np.ndarray, probes: DataFrame, threshold: float) -> np.ndarray:
    """Bitmap of the slots of the probes' prefix tokens: of fixed size, so it may go to the driver and to all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lines, on, _ in _probes(order, batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slot(_prefixes(lines, on, threshold)[2])).astype(np.int32))], ["slot"])

    bits = np.zeros(TOKEN_SLOTS, dtype=bool)
    bits[probes.mapInArrow(run, "slot int").distinct().toArrow().column("slot").to_numpy()] = True
    return np.packbits(bits)


def _rows(bucket: np.ndarray, found: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(found, pa.binary())], ["bucket", "blob"])


def _pairs(lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for all lo[i] <= j < hi[i], in chunks."""
    size = hi - lo
    ends = np.cumsum(size)
    at = 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS, side="right")))
        n = size[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]
        yield i, j
        at = stop


def _match_sets(rows: pa.Table) -> pa.Table:
    """All lines of equal token sets but the earliest."""
    parts = [blobs.unpack(x, _SAME) for x in rows.column("blob").to_pylist()]
    identity, second, crc, number = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 3, 4))
    doc = np.concatenate([blobs.undelta(p[2]) for p in parts])
    y = _firsts(np.lexsort((number, doc, second, identity)), identity, second)
    x = np.flatnonzero((doc != doc[y]) | (number != number[y]))
    y = y[x]
    return _table(doc[x], crc[x], number[x], doc[y], crc[y], number[y], np.zeros(len(x), bool))


class _Bucket:
    """Entries of a bucket by token and size, less tokens that occur once (they have no partner)."""

    def __init__(self, found: list[bytes]):
        parts = [blobs.unpack(x, _KINDS) for x in found]
        token, size, position, parity, high, crc, number, probe = (np.concatenate([p[i] for p in parts]) for i in (0, 1, 2, 3, 4, 6, 7, 8))
        doc = np.concatenate([blobs.undelta(p[5]) for p in parts])
        joint = (token.astype(np.int64) << 31) | np.minimum(size, (1 << 31) - 1)
        by = np.argsort(joint)
        t = token[by]
        alike = np.concatenate([[False], t[1:] == t[:-1]])
        by = by[alike | np.append(alike[1:], False)]
        self.token, self.size, self.position = (c[by].astype(np.int64) for c in (token, size, position))
        self.parity, self.high, self.crc, self.number, self.probe, self.doc = (c[by] for c in (parity, high, crc, number, probe, doc))
        self.joint = joint[by]
        self.tokens, self.left = self.size.astype(np.int32), (self.size - self.position).astype(np.int32)  # read for every pair
        self._needs: dict[float, np.ndarray] = {}

    def need(self, both: np.ndarray, threshold: float) -> np.ndarray:
        """The tokens in common that sets of ``both`` tokens together need; from a table, as pairs are many and sizes few."""
        if threshold not in self._needs:
            every = np.arange(2 * int(self.tokens.max(initial=0)) + 1)
            self._needs[threshold] = np.ceil(every * (threshold / (1 + threshold)) - _EPS).astype(np.int32)
        return self._needs[threshold][both]

    def behind(self, size: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The place behind the last entry of the token that has at most this size."""
        return np.searchsorted(self.joint, (token << 31) | np.minimum(size, (1 << 31) - 1), side="right")

    def fit(self, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that may be similar by size, position and parity, and a lower bound of their symmetric differences."""
        size = self.tokens
        both = size[i] + size[j]
        need = self.need(both, threshold)
        ok = np.minimum(self.left[i], self.left[j]) >= need
        i, j, both, need = i[ok], j[ok], both[ok], need[ok]
        # words of one width only may be compared: the wide line's are folded where the other is not wide
        wide = (size[i] >= WIDE_LINE) == (size[j] >= WIDE_LINE)
        low, top = self.parity[i] ^ self.parity[j], self.high[i] ^ self.high[j]
        apart = np.where(wide, np.bitwise_count(low) + np.bitwise_count(top), np.bitwise_count(low ^ top)).astype(np.int64)
        ok = apart <= both - 2 * need
        return i[ok], j[ok], apart[ok]

    def earlier(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (self.doc[y] < self.doc[x]) | ((self.doc[y] == self.doc[x]) & (self.number[y] < self.number[x]))

    def similar_sizes(self, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """For each of the entries ``x`` the range of the entries of its token that fit in size."""
        least = np.ceil(threshold * self.size[x] - _EPS).astype(np.int64)
        return self.behind(least - 1, self.token[x]), self.behind((self.size[x] / threshold + _EPS).astype(np.int64), self.token[x])


class _Nearest:
    """Of each entry the ``TOKEN_PARTNERS`` closest earlier partners so far, and how many there were."""

    def __init__(self, b: _Bucket):
        self.b, self.hits = b, np.zeros(len(b.token), dtype=np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def consider(self, x: np.ndarray, y: np.ndarray, apart: np.ndarray) -> None:
        ok = self.b.earlier(y, x)
        x, y, apart = x[ok], y[ok], apart[ok]
        if len(x):
            self.hits += np.bincount(x, minlength=len(self.hits))
            self.parts.append((x, y, apart))
            self.held += len(x)
            if self.held > _PAIRS:
                self.parts = [self.best()]
                self.held = len(self.parts[0][0])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y, apart = (np.concatenate([p[k] for p in self.parts] or [np.zeros(0, np.int64)]) for k in range(3))
        order = np.lexsort((self.b.doc[y], apart, x))
        x, y, apart = x[order], y[order], apart[order]
        behind = np.concatenate([np.zeros(min(TOKEN_PARTNERS, len(x)), bool), x[TOKEN_PARTNERS:] == x[:-TOKEN_PARTNERS]])
        return x[~behind], y[~behind], apart[~behind]


def _closest(b: _Bucket, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines and their closest earlier partners, how far these are at least, and whether there may be more."""
    n, near = len(b.token), _Nearest(b)
    start = np.flatnonzero(np.concatenate([[True], b.token[1:] != b.token[:-1]]))
    entries = np.diff(start, append=n)
    hot = np.repeat(entries > HOT_ENTRIES, entries)
    if hot.any():
        every = np.flatnonzero(hot)
        by = every[np.lexsort((b.number[every], b.doc[every], b.token[every]))]  # of each token the earliest first, in its own range
        first = np.repeat(start, entries)[every]
        place = np.full(n, -1)
        place[every] = by
        for i, k in _pairs(first, first + PIVOTS):
            near.consider(*b.fit(every[i], place[k], threshold))
        open_ = every[near.hits[every] == 0]
        near.hits[every] *= TOKEN_PARTNERS + 1  # the others were not looked at
        for i, j in _pairs(*b.similar_sizes(open_, threshold)):
            near.consider(*b.fit(open_[i], j, threshold))
    cold = np.flatnonzero(~hot)
    if len(cold):
        behind = b.behind((b.size[cold] / threshold + _EPS).astype(np.int64), b.token[cold])
        for i, j in _pairs(cold + 1, np.maximum(behind, cold + 1)):
            x, y, apart = b.fit(cold[i], j, threshold)
            near.consider(x, y, apart)
            near.consider(y, x, apart)
    x, y, apart = near.best()
    return x, y, apart, near.hits[x] > TOKEN_PARTNERS


def _match(n_buckets: int, threshold: float, every: bool):
    """Candidates of a bucket: per line the closest earlier partners, or all partners of the probes."""

    def run(rows: pa.Table) -> pa.Table:
        if rows.column("bucket")[0].as_py() < 0:
            parts = [blobs.unpack(x, ["<i8"] * 6) for x in rows.column("blob").to_pylist()]
            x_doc, x_crc, x_line, y_doc, y_crc, y_line = (np.concatenate([p[i] for p in parts]) for i in range(6))
            return _table(x_doc, x_crc, x_line, y_doc, y_crc, y_line, np.zeros(len(x_doc), bool))
        if rows.column("bucket")[0].as_py() >= n_buckets:
            return _match_sets(rows)
        b = _Bucket(rows.column("blob").to_pylist())
        if not len(b.token):
            none = np.zeros(0, np.int64)
            x, y, apart, more = none, none, none, none > 0
        elif every:
            asks = np.flatnonzero(b.probe > 0)
            met = []
            for i, j in _pairs(*b.similar_sizes(asks, threshold)):
                ok = (b.probe[j] == 0) & b.earlier(j, asks[i])
                met.append(b.fit(asks[i[ok]], j[ok], threshold))
            x, y, apart = (np.concatenate([m[k] for m in met] or [np.zeros(0, np.int64)]) for k in range(3))
            more = np.zeros(len(x), bool)
        else:
            x, y, apart, more = _closest(b, threshold)
        return _table(b.doc[x], b.crc[x], b.number[x], b.doc[y], b.crc[y], b.number[y], more, apart)

    return run


def _table(x_doc, x_crc, x_line, y_doc, y_crc, y_line, more, apart=None) -> pa.Table:
    """``apart``: a lower bound of the symmetric difference; None: the token sets are equal."""
    sure = np.full(len(more), apart is None)
    apart = np.zeros(len(more)) if apart is None else apart
    wide = [c.astype(np.int64) for c in (x_doc, x_crc, x_line, y_doc, y_crc, y_line)]
    wide[2], wide[5] = wide[2].astype(np.int32), wide[5].astype(np.int32)
    return pa.table(dict(zip([f.split()[0] for f in _FOUND.split(", ")], [*wide, more, sure, apart.astype(np.int32)], strict=True)))


def _judge(threshold: float):
    """Pairs of lines in, whether their token sets reach the threshold out; only A-Z are folded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            good, one, own = [], None, set()
            for x, y in zip(text_bytes(batch.column("x_text")), text_bytes(batch.column("y_text")), strict=True):
                if x != one:
                    one, own = x, set(x.lower().split())
                other = set(y.lower().split())
                both = len(own & other)
                good.append(both >= threshold * (len(own) + len(other) - both) - _EPS)
            kept = ["x_doc", "x_crc", "x_line", "more", "x_text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(good, pa.bool_())], ["doc", "crc", "line", "more", "x_text", "good"])

    return run


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The asked lines of documents."""
    for batch in rows_of(batches):
        doc, crc, number, text = [], [], [], []
        for d, c, asked, whole in zip(*(batch.column(k).to_pylist() for k in ("doc", "crc", "asked")), unsqueezed(batch.column("text")), strict=True):
            lines = whole.split(b"\n")
            for n in asked:
                doc.append(d), crc.append(c), number.append(n), text.append(lines[n])
        columns = [pa.array(doc, pa.int64()), pa.array(crc, pa.int64()), pa.array(number, pa.int32()), pa.array(text, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "crc", "line", "line_text"])


def _verified(packed: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """``doc, crc, line, good, more, x_text`` for each candidate's later line: whether a partner holds, whether there are more.
    ``packed``: ``doc, crc, text`` as frames, dealt by document."""
    key = ["doc", "crc", "line"]
    side = lambda s: [F.col(f"{s}_{k}").alias(k) for k in key]
    asked = found.select(*side("x")).unionByName(found.select(*side("y"))).groupBy("doc", "crc").agg(F.collect_set("line").alias("asked"))
    lines = packed.join(asked, ["doc", "crc"]).mapInArrow(_fetch, "doc long, crc long, line int, line_text string").dropDuplicates(key)
    named = lambda s: lines.select(*[F.col(k).alias(f"{s}_{k}") for k in key], F.col("line_text").alias(f"{s}_text"))
    pairs = found.join(named("y"), [f"y_{k}" for k in key]).join(named("x"), [f"x_{k}" for k in key])
    slim = pairs.select("x_doc", "x_crc", "x_line", "more", "x_text", "y_text")
    judged = slim.mapInArrow(_judge(threshold), "doc long, crc long, line int, more boolean, x_text string, good boolean")
    return judged.groupBy(*key).agg(F.max("good").alias("good"), F.max("more").alias("more"), F.first("x_text").alias("x_text"))


def _near_lines(keyed: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """``doc, crc, lines``: the numbers (from 0) of each document's lines that have an earlier match.

    ``keyed`` has ``doc, crc, text``; ``packed`` the same with texts as frames.
    """
    order, words = rarity(keyed)
    n_buckets = max(16, math.ceil(words * (1 - threshold) / BUCKET_ENTRIES))
    own = ["x_doc", "x_crc", "x_line"]
    rows = keyed.mapInArrow(_emit(order, n_buckets, threshold), "bucket long, blob binary")
    met = in_tasks(rows, 3 * n_buckets, TASK_BUCKETS).groupBy("bucket").applyInArrow(_match(n_buckets, threshold, False), _FOUND)
    partners = F.array_sort(F.collect_set(F.struct("apart", "y_doc", "y_crc", "y_line")))
    listed = met.groupBy(*own).agg(F.max("sure").alias("sure"), F.max("more").alias("more"), partners.alias("y"))
    several = F.col("more") | (F.size("y") > FIRST_PARTNERS)
    found = saved(listed.select(*own, "sure", several.alias("more"), F.slice("y", 1, FIRST_PARTNERS).alias("y")))
    open_ = found.where("not sure").select(*own, F.explode("y").alias("y"), "more").select(*own, "y.y_doc", "y.y_crc", "y.y_line", "more")
    checked = saved(_verified(packed, open_, threshold))
    gone = found.where("sure").toDF("doc", "crc", "line", "sure", "more", "y").select("doc", "crc", "line")
    gone = gone.unionByName(checked.where("good").select("doc", "crc", "line"))
    probes = checked.where("more and not good")
    if not probes.isEmpty():
        bitmap = _asked(order, probes, threshold)
        rows = keyed.mapInArrow(_emit(order, n_buckets, threshold, bitmap), "bucket long, blob binary")
        rows = rows.unionByName(probes.mapInArrow(_ask(order, n_buckets, threshold), "bucket long, blob binary"))
        wider = saved(in_tasks(rows, n_buckets, TASK_BUCKETS).groupBy("bucket").applyInArrow(_match(n_buckets, threshold, True), _FOUND).drop("sure", "apart").distinct())
        gone = gone.unionByName(_verified(packed, wider, threshold).where("good").select("doc", "crc", "line"))
    return saved(gone.groupBy("doc", "crc").agg(F.collect_set("line").alias("lines")))


def remove_near_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``text`` cut down to the lines that stay, and ``n_lines, n_removed``.

    Lines are split at \\n; lines without words always stay. A null text stays null with no lines; an
    emptied document stays with an empty text. Null ids order first. Rows that repeat id and text are one
    document and get the same result; an empty table gives no rows.
    """
    base = docs.drop("n_lines", "n_removed")
    p = prefix(base)
    doc, crc = order_key("doc_id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    keyed = base.select(doc.alias("doc"), crc.alias("crc"), F.coalesce("text", F.lit("")).alias("text"))
    frames = squeezed(base.withColumns({f"{p}doc": doc, f"{p}crc": crc, f"{p}null": F.col("text").isNull()}))
    held = saved(frames.repartition(partitions(docs.sparkSession), f"{p}doc", f"{p}crc"))
    gone = _near_lines(keyed, held.select(F.col(f"{p}doc").alias("doc"), F.col(f"{p}crc").alias("crc"), "text"), threshold)
    joined = held.join(gone.toDF(f"{p}doc", f"{p}crc", f"{p}lines"), [f"{p}doc", f"{p}crc"], "left")
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, SLICE_BYTES // 2):
            texts, counts, removed = [], [], []
            for text, out, null in zip(unsqueezed(batch.column("text")), batch.column(f"{p}lines").to_pylist(), batch.column(f"{p}null").to_pylist(), strict=True):
                counts.append(0 if null else text.count(b"\n") + 1)
                removed.append(len(out or ()))
                if out:
                    drop = set(out)
                    text = b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in drop)
                texts.append(None if null else text)
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_lines", "n_removed"])

    return joined.select(*names, f"{p}lines", f"{p}null").mapInArrow(run, with_fields(base, "n_lines long, n_removed long"))
