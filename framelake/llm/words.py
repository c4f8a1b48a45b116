"""Words of many texts at once, as numpy arrays.

A word is a run of bytes other than space and \\x09-\\x0D (``[^\\x20\\x09-\\x0D]+``).
The texts of a block are joined by a blank, so no word crosses two texts; all
helpers work on blocks of a bounded number of bytes, whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_BYTES = 4 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_P1 = np.uint64(0x9E3779B97F4A7C15)
_P2 = np.uint64(0xD6E8FEB86659FD93)
_S32 = np.uint64(32)
_S29 = np.uint64(29)


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts that hold about ``limit`` bytes (a longer text stands alone)."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each word in a byte buffer."""
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    np.logical_not(_SPACE[buf], out=inside[1:-1].view(bool))
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> _S32)
    h = h * _P2
    h = h ^ (h >> _S29)
    h = h * _P1
    return h ^ (h >> _S32)


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, read eight bytes at a time."""
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray(shape=(len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = end - start
    h = mix((eight[start] & _MASK[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * _P1))
    more = np.flatnonzero(size > 8)
    at = 8
    while len(more):
        left = np.minimum(size[more] - at, 8)
        h[more] = mix(h[more] ^ (eight[start[more] + at] & _MASK[left])) + _P1
        at += 8
        more = more[size[more] > at]
    return h


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the words of all ``texts``: buffer, starts, hashes; and ``first``: the words of text
    i are ``first[i]:first[i + 1]``."""
    buf = np.frombuffer(b" ".join(texts), dtype=np.uint8)
    start, end = word_spans(buf)
    length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate([[0], np.cumsum(length + 1)])
    return buf, start, hash_spans(buf, start, end), np.searchsorted(start, begins)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` neighbouring hashes (order counts); empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = h[:n].copy()
    for i in range(1, k):
        out = mix(out * _P1 + h[i : i + n])
    return out
