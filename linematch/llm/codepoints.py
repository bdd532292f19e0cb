"""Arrow strings as numpy arrays of code points and back, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def decode(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings one after the other, and the n + 1 offsets of the strings. NULL has no code points."""
    strings = strings.cast(pa.large_string())
    n = len(strings)
    _, ends, data = strings.buffers()
    offsets = np.frombuffer(ends, np.int64, n + 1, strings.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
    first = (raw & 0xC0) != 0x80
    counts = np.concatenate([[0], np.cumsum(first)])
    at = np.flatnonzero(first)
    lead = raw[at].astype(np.uint32)
    padded = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.uint32)
    cps = lead.copy()
    two, three, four = (lead >= 0xC0) & (lead < 0xE0), (lead >= 0xE0) & (lead < 0xF0), lead >= 0xF0
    tail = lambda where, k: padded[at[where] + k] & 0x3F
    cps[two] = (lead[two] & 0x1F) << 6 | tail(two, 1)
    cps[three] = (lead[three] & 0x0F) << 12 | tail(three, 1) << 6 | tail(three, 2)
    cps[four] = (lead[four] & 0x07) << 18 | tail(four, 1) << 12 | tail(four, 2) << 6 | tail(four, 3)
    return np.minimum(cps, 0x10FFFF), counts[offsets - offsets[0]]


def encode(cps: np.ndarray, offsets: np.ndarray, nulls: np.ndarray | None = None) -> pa.Array:
    """The strings of decode()'s form; nulls marks those that are NULL."""
    size = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(size)])
    raw = np.empty(ends[-1], np.uint8)
    marks = np.array([0, 0, 0xC0, 0xE0, 0xF0], np.uint32)
    raw[ends[:-1]] = (cps >> (6 * (size - 1)).astype(np.uint32)) | marks[size]
    for k in (1, 2, 3):
        has = size > k
        raw[ends[:-1][has] + k] = (cps[has] >> (6 * (size[has] - 1 - k)).astype(np.uint32)) & 0x3F | 0x80
    valid = None
    if nulls is not None and nulls.any():
        valid = pa.array(~nulls).buffers()[1]
    offs = ends[offsets].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [valid, pa.py_buffer(offs), pa.py_buffer(raw)]).cast(pa.string())


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each code point."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def kept(cps: np.ndarray, offsets: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the code points under keep, with the offsets moved."""
    counts = np.concatenate([[0], np.cumsum(keep)])
    return cps[keep], counts[offsets]


def taken(cps: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings of some rows, in the given order."""
    sizes = np.diff(offsets)[rows]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    index = np.arange(ends[-1]) + np.repeat(offsets[:-1][rows] - ends[:-1], sizes)
    return cps[index], ends


def expanded(cps: np.ndarray, offsets: np.ndarray, start: np.ndarray, size: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code point replaced by size[cp] values of data from start[cp]; size 0 keeps it."""
    many = size[cps]
    if not many.any():
        return cps, offsets
    width = np.where(many == 0, 1, many).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(width)])
    out = np.repeat(cps, width)
    inner = np.arange(ends[-1]) - np.repeat(ends[:-1], width)
    swapped = np.repeat(many > 0, width)
    out[swapped] = data[(np.repeat(start[cps], width) + inner)[swapped]]
    return out, ends[offsets]


def differing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each row whether the two strings differ."""
    n = np.diff(a[1])
    unequal = n != np.diff(b[1])
    same = np.flatnonzero(~unequal)
    x, ends = taken(*a, same)
    y, _ = taken(*b, same)
    off = np.concatenate([[0], np.cumsum(x != y)])
    unequal[same] = off[ends[1:]] > off[ends[:-1]]
    return unequal
