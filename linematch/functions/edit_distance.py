"""Levenshtein distances of many pairs at once, bit-parallel over numpy arrays."""

from __future__ import annotations

import numpy as np

#: Pairs whose distances are computed at once.
_CHUNK = 1 << 17
_WORD = 64


def plain_distance(a: str, b: str) -> int:
    """The distance of one pair by the table of prefixes, for texts of any length."""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


class Patterns:
    """Strings that others are compared with: bit masks of the places of each letter."""

    def __init__(self, keys: list[str]) -> None:
        self.keys = keys
        self.letters = {c: i + 1 for i, c in enumerate(sorted({c for k in keys for c in k}))}
        codes, self.sizes = self.coded(keys)
        self.masks = np.zeros((len(keys), len(self.letters) + 1), np.uint64)
        for j in range(min(_WORD, codes.shape[1])):
            here = np.flatnonzero(self.sizes > j)
            self.masks[here, codes[here, j]] |= np.uint64(1) << np.uint64(j)
        self.codes = codes

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of the patterns as numbers, 0 for any other, and the lengths."""
        sizes = np.array([len(t) for t in texts], np.int64)
        codes = np.zeros((len(texts), max(1, int(sizes.max(initial=1)))), np.int16)
        get = self.letters.get
        for i, t in enumerate(texts):
            codes[i, : len(t)] = [get(c, 0) for c in t]
        return codes, sizes

    def distances(self, nodes: np.ndarray, codes: np.ndarray, sizes: np.ndarray, rows: np.ndarray, texts: list[str]) -> np.ndarray:
        """The distance of each pattern in nodes to the text in rows; codes and sizes are those of texts."""
        out = np.empty(len(nodes), np.int64)
        for a in range(0, len(nodes), _CHUNK):
            n, r = nodes[a : a + _CHUNK], rows[a : a + _CHUNK]
            out[a : a + _CHUNK] = _bit_parallel(self.masks, n, self.sizes[n], codes, sizes[r], r)
        for i in np.flatnonzero(self.sizes[nodes] > _WORD):
            out[i] = plain_distance(self.keys[nodes[i]], texts[rows[i]])
        return out


def _bit_parallel(masks: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, codes: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Myers' algorithm for patterns of up to 64 letters, a letter of all texts at a time."""
    order = np.argsort(-lengths, kind="stable")
    node, row, length, size = nodes[order], rows[order], lengths[order], np.minimum(sizes[order], _WORD)
    score = size.astype(np.int64)
    last = np.uint64(1) << (np.maximum(size, 1) - 1).astype(np.uint64)
    plus, minus = np.full(len(size), ~np.uint64(0)), np.zeros(len(size), np.uint64)
    one = np.uint64(1)
    for j in range(int(length[0]) if len(length) else 0):
        n = int(np.searchsorted(-length, -j, "left"))  # texts longer than j
        p, m, top = plus[:n], minus[:n], last[:n]
        eq = masks[node[:n], codes[row[:n], j]]
        xh = (((eq & p) + p) ^ p) | eq
        ph, mh = m | ~(xh | p), p & xh
        score[:n] += ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0)
        ph, mh = (ph << one) | one, mh << one
        xv = eq | m
        plus[:n], minus[:n] = mh | ~(xv | ph), ph & xv
    score[size == 0] = length[size == 0]
    out = np.empty(len(score), np.int64)
    out[order] = score
    return out
