"""Integer columns packed into one binary value, so that a shuffle moves few, compact rows.

Columns are stored one after another, split into planes of equal byte places: the high planes
are mostly zero and vanish under the shuffle's own compression.
"""

from __future__ import annotations

import numpy as np


def pack(columns: list[np.ndarray]) -> bytes:
    """``columns`` of equal kind on both sides: unsigned or signed integers of any lengths."""
    parts = [np.array([len(c) for c in columns], dtype="<i8").tobytes()]
    for column in columns:
        width = column.dtype.itemsize
        parts.append(np.ascontiguousarray(np.ascontiguousarray(column).view(np.uint8).reshape(-1, width).T).tobytes())
    return b"".join(parts)


def unpack(blob: bytes, kinds: list[str]) -> list[np.ndarray]:
    """The columns that ``pack`` got; ``kinds`` are their numpy types."""
    at = 8 * len(kinds)
    lengths = np.frombuffer(blob, dtype="<i8", count=len(kinds))
    out = []
    for kind, n in zip(kinds, lengths.tolist(), strict=True):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(blob, dtype=np.uint8, count=n * width, offset=at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += n * width
    return out


def delta(values: np.ndarray) -> np.ndarray:
    """Differences to the value before (the first: to 0), wrapping."""
    return np.diff(values, prepend=values.dtype.type(0))


def undelta(values: np.ndarray) -> np.ndarray:
    return np.cumsum(values, dtype=values.dtype)
