"""Order-preserving packing by dynamic programming.

Documents keep their order; a window is a run of at most ``SIZE`` neighbouring tokens and
becomes one sequence. Windows may end behind a document (free), behind a sentence
(``SENTENCE_COST``) or, where a sentence runs on for long, at a spare cut (``HARD_COST``). The
cost of a window is its padding - none at a power of two - and that of its cut.
With D[j] the least cost of all tokens before boundary j,

    D[j] = cut(j) + min(min over i >= j - SIZE of (D[i] + i) + SIZE - j, min over k of D[j - 2^k])

The inner minimum is over a sliding window and kept in a monotone queue, so a boundary costs
amortised constant time plus the powers of two.

Each task packs the rows of its input split in the order in which they are stored; nothing is
shuffled. Token runs are packed in stretches of ``STRETCH`` tokens; the last few windows of a
stretch stay open and go into the next, so memory does not follow the split.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import rows_of

SIZE = 2048
END_ID = 1
SENTENCE_COST = 32
HARD_COST = 128
#: A spare cut for each so many tokens without a boundary.
SPARE = 128
STRETCH = 1 << 19
OPEN_WINDOWS = 4

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@cache
def encoder(path: str, special: bool = False) -> tiktoken.Encoding:
    """The byte-level BPE whose ranks lie beside ``path`` (the same vocabulary as the tokenizers file); ``special``: with
    the added tokens of that file."""
    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path.removesuffix(".json") + ".tiktoken", "rb"))}
    added = {x["content"]: x["id"] for x in json.load(open(path, encoding="utf-8"))["added_tokens"]} if special else {}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


@cache
def _sentence_ids(path: str, special: bool = False) -> np.ndarray:
    """Which ids end a sentence: their bytes end in . ! ? or hold a line break."""
    enc = encoder(path, special)
    ends = re.compile(rb"[.!?][\"')\]]*$|\n")
    return np.array([bool(ends.search(enc.decode_single_token_bytes(i))) for i in range(enc.max_token_value + 1)])


def token_ids(text: str | None, path: str, special: bool = False) -> np.ndarray:
    """Ids of a text and the id that ends a document. The string of an added token within a text is ordinary text (the
    ``encode_special_tokens = True`` of the tokenizers file's own description), or that token's id where ``special``."""
    ids = encoder(path, special).encode_to_numpy(text, allowed_special="all", disallowed_special=()) if text else np.zeros(0, np.uint32)
    return np.append(ids, np.uint32(END_ID)).astype(np.uint32)


def boundaries(ends: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may end, ascending, and the cost of a cut there. ``ends``: of the documents; ``sentence``:
    a flag for each token, the last of a sentence."""
    cuts = np.union1d(np.flatnonzero(sentence) + 1, ends)
    gap = np.diff(cuts, prepend=0)
    wide = np.flatnonzero(gap > SPARE)
    spare = [np.arange(cuts[i] - gap[i] + SPARE, cuts[i], SPARE) for i in wide]
    cost = np.full(len(cuts), SENTENCE_COST)
    cost[np.isin(cuts, ends)] = 0
    if spare:
        extra = np.concatenate(spare)
        cuts, cost = np.concatenate([cuts, extra]), np.concatenate([cost, np.full(len(extra), HARD_COST)])
        order = np.argsort(cuts)
        cuts, cost = cuts[order], cost[order]
    return cuts, cost


def best_cuts(cuts: np.ndarray, cost: np.ndarray) -> list[int]:
    """The ends of the windows of least total cost; the last is ``cuts[-1]``."""
    ends, costs = [0, *cuts.tolist()], [0, *cost.tolist()]
    place = {p: i for i, p in enumerate(ends)}
    best, came = [0] * len(ends), [0] * len(ends)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # D + position, position, number: both ascending
    powers = [1 << k for k in range(SIZE.bit_length() - 2, 3, -1)]
    for j in range(1, len(ends)):
        end = ends[j]
        while queue[0][1] < end - SIZE:
            queue.popleft()
        least, _, i = queue[0]
        least += SIZE - end
        for power in powers:
            other = place.get(end - power)
            if other is not None and best[other] < least:
                least, i = best[other], other
        least += costs[j]
        best[j], came[j] = least, i
        reach = least + end
        while queue and queue[-1][0] >= reach:
            queue.pop()
        queue.append((reach, end, j))
    out, j = [], len(ends) - 1
    while j:
        out.append(ends[j])
        j = came[j]
    return out[::-1]


class _Packer:
    """Packs a stream of documents; holds only what no closed window has taken."""

    def __init__(self, first_sequence: int, sentences: np.ndarray):
        self.sequence, self.sentences = first_sequence, sentences
        self.docs: list[tuple[int | None, np.ndarray, int]] = []  # id, ids not yet in a window, tokens that are
        self.size = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0))
        self.size += len(ids)

    def close(self, last: bool) -> list[tuple]:
        """Pieces of the windows that are certain: all, or all but a few."""
        if not self.size:
            return []
        ends = np.cumsum([len(ids) for _, ids, _ in self.docs])
        tokens = np.concatenate([ids for _, ids, _ in self.docs])
        cuts, cost = boundaries(ends, self.sentences[tokens])
        windows = best_cuts(cuts, cost)
        if not last:
            windows = windows[:-OPEN_WINDOWS]
        pieces, begin, at, used = [], 0, 0, 0
        for end in windows:
            offset = 0
            while begin < end:
                doc_id, ids, before = self.docs[at]
                take = min(len(ids) - used, end - begin)
                part = ids[used : used + take]
                pieces.append((doc_id, before + used, take, zlib.crc32(part.tobytes()), before + len(ids), self.sequence, offset))
                begin, offset, used = begin + take, offset + take, used + take
                if used == len(ids):
                    at, used = at + 1, 0
            self.sequence += 1
        rest = self.docs[at:]
        if rest and used:
            doc_id, ids, before = rest[0]
            rest[0] = (doc_id, ids[used:], before + used)
        self.docs, self.size = rest, self.size - begin
        return pieces


def pack(docs: DataFrame, tokenizer: str | None = None, stretch: int = STRETCH, special: bool = False) -> DataFrame:
    """Pieces of all documents: one row per document and sequence that it lies in.

    ``start`` counts the document's ids before the piece, ``offset`` those before it in the
    sequence; ``sequence_id`` names the task and the window. A null or empty text is the end id
    alone. ``special``: see ``token_ids``. Rows that repeat a doc_id are packed one by one. Ties in cost take the earlier
    cut. An empty table gives no rows; other columns are ignored. Order, windows and ``sequence_id`` follow the input splits,
    so files or splits of another size give another packing of the same documents; each split ends on one short sequence.
    """
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(TaskContext.get().partitionId() << 40, _sentence_ids(path, special))
        for batch in rows_of(batches, 4 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                packer.add(doc_id, token_ids(text, path, special))
                if packer.size >= stretch:
                    yield _batch(packer.close(False))
        yield _batch(packer.close(True))

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def _batch(pieces: list[tuple]) -> pa.RecordBatch:
    columns = zip(*pieces, strict=True) if pieces else [[]] * 7
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)
