"""A BK-tree over strings under the Levenshtein metric, searched for many queries at once.

Nodes and queries are numpy arrays; a search moves all (query, node) pairs of
one level together, so that a distance costs a few array operations over all
of them. With pivot distance d and threshold t only children at an edge of
d - t to d + t are visited: by the triangle inequality no other subtree can
hold an entry within t, so every such entry is found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from linematch.functions.edit_distance import Patterns

@dataclass
class BKTree:
    """keys are distinct strings; node i is keys[i]."""

    keys: list[str]

    def __post_init__(self) -> None:
        self.patterns = Patterns(self.keys)
        self._build()

    def _build(self) -> None:
        n = len(self.keys)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        rest = np.arange(1, n)
        pivot = np.zeros(len(rest), np.int64)
        while len(rest):  # a level at a time: each group's first member is its node
            d = self.patterns.distances(pivot, self.patterns.codes, self.patterns.sizes, rest, self.keys)
            group = pivot * (1 << 20) + d
            order = np.lexsort((rest, group))
            rest, pivot, d, group = rest[order], pivot[order], d[order], group[order]
            first = np.concatenate([[True], group[1:] != group[:-1]])
            parent[rest[first]], edge[rest[first]] = pivot[first], d[first]
            mine = rest[first][np.cumsum(first) - 1]
            rest, pivot = rest[~first], mine[~first]
        kids = np.flatnonzero(parent >= 0)
        self.kid_key = parent[kids] * (1 << 20) + edge[kids]
        order = np.argsort(self.kid_key, kind="stable")
        self.kids, self.kid_key = kids[order], self.kid_key[order]

    def within(self, texts: list[str], limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, node, distance) of every key within each text's limit."""
        none = np.zeros(0, np.int64)
        if not self.keys or not texts:
            return none, none, none
        # A text longer than any key by more than its limit has no key within it.
        able = np.flatnonzero(np.array([len(t) for t in texts]) <= limits + self.patterns.sizes.max())
        if not len(able):
            return none, none, none
        some = [texts[i] for i in able]
        codes, sizes = self.patterns.coded(some)
        limit = np.asarray(limits)[able]
        q, node, found = np.arange(len(some)), np.zeros(len(some), np.int64), []
        while len(q):
            d = self.patterns.distances(node, codes, sizes, q, some)
            hit = d <= limit[q]
            found.append((able[q[hit]], node[hit], d[hit]))
            low = np.searchsorted(self.kid_key, node * (1 << 20) + np.maximum(d - limit[q], 0), "left")
            high = np.searchsorted(self.kid_key, node * (1 << 20) + d + limit[q], "right")
            many = high - low
            ends = np.concatenate([[0], np.cumsum(many)])
            at = np.arange(ends[-1]) - np.repeat(ends[:-1] - low, many)
            q, node = np.repeat(q, many), self.kids[at]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
