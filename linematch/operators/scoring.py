"""Scores of query texts against a block of products, as matrices.

Terms that products share are compared once. Edit distances are bit-parallel,
shared words come from postings, and maxima by product are reductions over the
terms in product order; no pair of query and product ever is a row.

For the k best, distances are computed only where they can matter: letters of
one text that the other lacks bound the distance from below, so that every
product has a highest possible score; products whose highest possible score is
under the k-th best score found can't be among the best. Nothing is lost by it.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np

from linematch.functions.edit_distance import Patterns
from linematch.functions.similarity import CHAR_WEIGHT, LENGTH_BOUND, TOKEN_WEIGHT

#: Fixed values of the score.
WEIGHTS = {"text": 0.42, "token": 0.22, "exact": 0.16, "brand": 0.05, "ocr": 0.10, "unit": 0.05}
EXACT_BONUS = 0.10
NEAR_BONUS = 0.04
NEAR_TEXT = 0.88
EVIDENCE = (0.45, 0.35, 0.20)
ALIAS_BYTES_RATIO = 3


@dataclass
class Product:
    """A product with its terms normalised; brand is as given."""

    catalog_pos: int
    sku: str
    canonical_name: str
    name: str
    aliases: list[str]
    errors: list[str]
    brand: str
    brand_norm: str
    units: list[str]


class _Lists:
    """Term numbers of a list field, product after product, for maxima by product."""

    def __init__(self, lists: list[list[int]]) -> None:
        self.at = np.array([i for x in lists for i in x], np.int64)
        sizes = np.array([len(x) for x in lists], np.int64)
        self.owners = np.flatnonzero(sizes)
        self.starts = (np.cumsum(sizes) - sizes)[self.owners]

    def owned(self) -> list[tuple[int, int]]:
        """(term, product) of every entry."""
        sizes = np.diff(np.append(self.starts, len(self.at)))
        return list(zip(self.at.tolist(), np.repeat(self.owners, sizes).tolist(), strict=True))

    def most(self, values: np.ndarray, into: np.ndarray) -> np.ndarray:
        """into (query, product), raised to the most of values (query, term) over each product's terms."""
        if len(self.at):
            into[:, self.owners] = np.maximum(into[:, self.owners], np.maximum.reduceat(values[:, self.at], self.starts, axis=1))
        return into


class Block:
    """Products in catalog order."""

    def __init__(self, products: list[Product]) -> None:
        self.products = sorted(products, key=lambda p: (p.catalog_pos, p.sku))
        terms = sorted({t for p in products for t in (p.name, *p.aliases, *p.errors, *([p.brand_norm] if p.brand else []))})
        self.number = {t: i for i, t in enumerate(terms)}
        self.patterns = Patterns(terms)
        self.bytes = np.array([len(t.encode()) for t in terms], np.int64)
        words = defaultdict(list)
        for i, t in enumerate(terms):
            for w in set(t.split(" ")) if t else ():
                words[w].append(i)
        self.words = {w: np.array(x) for w, x in words.items()}
        number = self.number.__getitem__
        self.names = np.array([number(p.name) for p in self.products], np.int64)
        self.aliases = _Lists([[number(a) for a in p.aliases] for p in self.products])
        self.errors = _Lists([[number(e) for e in p.errors] for p in self.products])
        at = [*zip(self.names.tolist(), range(len(self.names))), *self.aliases.owned(), *self.errors.owned()]
        self.branded = np.array([i for i, p in enumerate(self.products) if p.brand], np.int64)
        self.brands = np.array([number(self.products[i].brand_norm) for i in self.branded], np.int64)
        at += zip(self.brands.tolist(), self.branded.tolist())
        users = np.array(sorted(at), np.int64).reshape(-1, 2)
        # The products that use each term, term after term.
        self.users, self.user_starts = users[:, 1], np.searchsorted(users[:, 0], np.arange(len(terms)))
        self.letters = np.zeros((len(terms), len(self.patterns.letters) + 1), np.float32)
        np.add.at(self.letters, (np.repeat(np.arange(len(terms)), self.patterns.sizes), _flat(self.patterns.codes, self.patterns.sizes)), 1)
        self.units = defaultdict(lambda: np.zeros(len(self.products)))
        for i, p in enumerate(self.products):
            for u in p.units:
                self.units[u][i] = 1.0

    def compare(self, queries: list[str]) -> "Comparison":
        return Comparison(self, queries)

    def similarities(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """hybrid, shared words and equality of every query and term."""
        c = self.compare(queries).exact(np.ones((len(queries), len(self.number)), bool))
        return c.hybrid, c.shared, c.equal

    def using(self, products: np.ndarray) -> np.ndarray:
        """Which terms any of the marked products (query, product) uses."""
        return np.logical_or.reduceat(products[:, self.users], self.user_starts, axis=1)

    def components(self, queries: list[str], compared: "Comparison | None" = None) -> dict[str, np.ndarray]:
        """best, tok, exact and brand of every query and product."""
        if compared is None:
            compared = self.compare(queries).exact(np.ones((len(queries), len(self.number)), bool))
        hybrid, shared, equal = compared.hybrid, compared.shared, compared.equal
        size = np.array([len(q.encode()) for q in queries])[:, None]
        comparable = (self.bytes > 0) & (size <= ALIAS_BYTES_RATIO * self.bytes) & (self.bytes <= ALIAS_BYTES_RATIO * size)
        best = self.aliases.most(np.where(comparable, hybrid, 0.0), hybrid[:, self.names].copy())
        best = self.errors.most(hybrid, best)
        tok = self.aliases.most(shared, shared[:, self.names].copy())
        by_name = equal[:, self.names]
        by_alias = self.aliases.most(equal, np.zeros_like(by_name)) & ~by_name
        brand = np.zeros(best.shape)
        brand[:, self.branded] = hybrid[:, self.brands]
        brand[by_name] = 0.0
        for i, j in zip(*np.nonzero(by_alias), strict=True):
            brand[i, j] = float(bool(self.products[j].brand) and self.products[j].brand in queries[i])
        exact = by_name | by_alias
        return {"best": np.where(exact, 1.0, best), "tok": tok, "exact": exact.astype(float), "brand": brand}


def _flat(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return codes[np.arange(codes.shape[1]) < sizes[:, None]]


class Comparison:
    """Queries beside the terms of a block: hybrid is the highest possible value until exact() has been asked for."""

    def __init__(self, block: Block, queries: list[str]) -> None:
        self.block, self.queries = block, queries
        ours, theirs = np.array([len(q) for q in queries], np.int64)[:, None], block.patterns.sizes[None, :]
        self.longer = np.maximum(np.maximum(ours, theirs), 1).astype(float)
        by_length = 1.0 - np.abs(ours - theirs) / self.longer
        self.equal = np.zeros(by_length.shape, bool)
        self.shared = np.zeros(by_length.shape)
        for i, q in enumerate(queries):
            if (n := block.number.get(q)) is not None:
                self.equal[i, n] = True
            words = q.split(" ")
            for w in words if q else ():
                if w in block.words:
                    self.shared[i, block.words[w]] += 1.0
            self.shared[i] /= len(words)
        both = (ours > 0) & (theirs > 0)
        self.shared[self.equal & both] = 1.0
        # Under the bound by length that bound is the value itself; an empty text is like no other.
        self.open = both & ~self.equal & (by_length >= LENGTH_BOUND)
        near = self.open.any(axis=1)
        self.codes, self.sizes = block.patterns.coded([q if near[i] else "" for i, q in enumerate(queries)])
        self.hybrid = self._hybrid(np.where(self.open, self._most_alike(by_length), np.where(both | self.equal, by_length, 0.0)))

    def _most_alike(self, by_length: np.ndarray) -> np.ndarray:
        """What the letters of either text that the other lacks leave possible."""
        mine = np.zeros((len(self.queries), self.block.letters.shape[1]), np.float32)
        np.add.at(mine, (np.repeat(np.arange(len(self.queries)), self.sizes), _flat(self.codes, self.sizes)), 1)
        theirs = self.block.letters
        known = np.ones(mine.shape[1], np.float32)
        known[0] = 0  # letters of no term
        lacking = np.maximum(
            self.sizes[:, None] - (mine * known) @ (theirs > 0).astype(np.float32).T, self.block.patterns.sizes[None, :] - ((mine > 0) * known) @ theirs.T
        )
        return np.minimum(by_length, 1.0 - lacking / self.longer)

    def _hybrid(self, chars: np.ndarray) -> np.ndarray:
        return np.where(self.equal, 1.0, CHAR_WEIGHT * chars + TOKEN_WEIGHT * self.shared)

    def exact(self, wanted: np.ndarray) -> "Comparison":
        """Has the exact value wherever wanted (query, term)."""
        row, term = np.nonzero(wanted & self.open)
        far = self.block.patterns.distances(term, self.codes, self.sizes, row, self.queries)
        self.hybrid[row, term] = CHAR_WEIGHT * (1.0 - far / self.longer[row, term]) + TOKEN_WEIGHT * self.shared[row, term]
        self.open[row, term] = False
        return self


def total_score(c: dict[str, np.ndarray], ocr: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """The weighted score, at most 1; the order of additions is part of the result."""
    w = WEIGHTS
    plain = w["text"] * c["best"] + w["token"] * c["tok"] + w["exact"] * c["exact"] + w["brand"] * c["brand"]
    plain = plain + w["ocr"] * ocr + w["unit"] * unit
    bonus = np.where(c["exact"] > 0.99, EXACT_BONUS, np.where(c["best"] > NEAR_TEXT, NEAR_BONUS, 0.0))
    return np.minimum(plain + bonus, 1.0)


def catalog_evidence(c: dict[str, np.ndarray], unit: np.ndarray) -> np.ndarray:
    base, text, with_unit = EVIDENCE
    return base + text * np.maximum(np.maximum(c["exact"], c["best"]), c["tok"]) + with_unit * unit


def best_columns(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k highest scores of each row, the highest first, equal ones in column order."""
    n = score.shape[1]
    if k < n:
        least = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
        row, column = np.nonzero(score >= least)
    else:
        row, column = np.nonzero(np.ones(score.shape, bool))
    order = np.lexsort((column, -score[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], column[place < k]
