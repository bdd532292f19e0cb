"""Free-typed values mapped to the entry of a reference list that they name.

A value is brought to the consistent form, amounts and comments are taken off,
and what is left is searched in BK-trees over all names and aliases: as typed
without blanks, with its words sorted, and, if it has no vowels, by its
consonants. Each search returns every entry within the threshold.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linematch.functions.amounts import UNITS, WORDS
from linematch.functions.text import DEVANAGARI_DIGITS, GUJARATI_DIGITS
from linematch.llm.bktree import BKTree
from linematch.llm.consistent import consistent_strings

NONE = "NONE"
#: Comments that shops leave beside the name.
COMMENTS = [
    "as usual", "good quality", "for shop", "fresh", "loose", "clean", "nice", "urgent",
    "તાજું", "દેશી", "છૂટું", "સારું", "खुला", "देसी", "अच्छा", "ताजा",
]
#: Names that one broadcast index may hold; a longer list is searched in shards.
MAX_NAMES = 20_000
#: Distinct values that one task of the sharded search takes.
GROUP_VALUES = 20_000
_CACHE = 200_000
_KINDS = ["name", "alias", "ocr_error"]

_LETTER = "\\w\u0900-\u0dff"
_NUMBER = "(?:\\d+(?:\\s+\\d+\\s?/\\s?\\d+|\\s*[¼-¾⅐-⅞]|\\s?[.,/]\\s?\\d+)?|[¼-¾⅐-⅞])"


def _any(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


_AMOUNT = re.compile(
    f"(?<![{_LETTER}])(?:\\d+\\s*[x×]\\s*)?(?:{_NUMBER}\\s*|(?:{_any(WORDS)})\\s+)(?:{_any(UNITS)})(?![{_LETTER}])"
    f"(?:\\s*[x×]\\s*\\d+(?![{_LETTER}]))?"
)
_WORD = re.compile("(?:[^\\W_]|[\u0900-\u0963\u0966-\u0dff])+")
_PLAIN_DIGITS = str.maketrans(GUJARATI_DIGITS + DEVANAGARI_DIGITS, "0123456789" * 2, "\u200c\u200d")
_ACCENT = re.compile("[\u0300-\u036f]")
_VOWEL = re.compile("[aeiouy]")


def words_of(text: str) -> list[str]:
    """Words of a consistent text in lower case without accents of Latin letters, amounts and plain numbers."""
    text = text.lower().translate(_PLAIN_DIGITS)
    if not text.isascii():
        text = unicodedata.normalize("NFC", _ACCENT.sub("", unicodedata.normalize("NFD", text)))
    return [w for w in _WORD.findall(_AMOUNT.sub(" ", text)) if not w.isdigit()]


def consonants(words: list[str]) -> str:
    """Each word's first letter and what is left of it without vowels."""
    return "".join(w[0] + _VOWEL.sub("", w[1:]) for w in words)


def _phrases(comments: list[str]) -> re.Pattern | None:
    return re.compile(f"(?<!\\S)(?:{_any(comments)})(?!\\S)") if comments else None


def _without(phrases: re.Pattern | None, words: str) -> str:
    return " ".join(phrases.sub(" ", words).split()) if phrases else words


def threshold(length: int) -> int:
    """Edits within which a name of so many characters is still named."""
    return 0 if length < 5 else 1 if length < 9 else 2


@dataclass
class NameIndex:
    """BK-trees over names: rows of (sku, catalog_pos, kind, name)."""

    rows: list[tuple[str, int, int, str]]

    def __post_init__(self) -> None:
        named = [(sku, pos, kind, words) for sku, pos, kind, name in self.rows if (words := words_of(name))]
        said = {w for *_, words in named for w in words}
        self.comment = _phrases([c for c in COMMENTS if not said & set(c.split())])
        self.word = _phrases([c for c in COMMENTS if said & set(c.split())])
        self.trees: list[tuple[Callable[[list[str]], str], BKTree, list[tuple]]] = []
        for form in ("".join, lambda w: " ".join(sorted(w)), consonants):
            best: dict[str, tuple] = {}
            for sku, pos, kind, words in named:
                key, this = form(words), (kind, pos, sku)
                best[key] = min(best.get(key, this), this)
            keys = sorted(best)
            self.trees.append((form, BKTree(keys), [best[k] for k in keys]))

    def search(self, keys: list[str]) -> list[tuple | None]:
        """For each text of words the best (form, distance, kind, catalog_pos, sku) within the threshold, or None.

        Comments are taken off; one that some name has too only where nothing is found with it.
        """
        keys = [_without(self.comment, k) for k in keys]
        out = self._search(keys)
        bare = {i: _without(self.word, k) for i, k in enumerate(keys) if out[i] is None} if self.word else {}
        bare = {i: k for i, k in bare.items() if k != keys[i]}
        for i, found in zip(bare, self._search(list(bare.values())), strict=True):
            out[i] = found
        return out

    def _search(self, keys: list[str]) -> list[tuple | None]:
        out: list[tuple | None] = [None] * len(keys)
        words = [k.split() for k in keys]
        open_ = [i for i, w in enumerate(words) if w]
        for n, (form, tree, entries) in enumerate(self.trees):
            if n == 2:
                open_ = [i for i in open_ if consonants(words[i]) == "".join(words[i])]
            texts = [form(words[i]) for i in open_]
            # The threshold is the name's; a name within it of a value of length m has at most m + 2 characters.
            limits = np.array([0 if n == 2 else threshold(len(t) + 2) for t in texts], np.int64)
            for q, node, d in zip(*(x.tolist() for x in tree.within(texts, limits)), strict=True):
                i = open_[q]
                if d <= threshold(len(tree.keys[node])):
                    this = (n, d, *entries[node])
                    out[i] = this if out[i] is None else min(out[i], this)
            open_ = [i for i in open_ if out[i] is None]
        return out


def names_of(products: DataFrame, lists: tuple[str, ...] = ("aliases_en", "aliases_gu", "aliases_hi"), errors: str = "ocr_errors") -> DataFrame:
    """sku, catalog_pos, kind (0 name, 1 alias, 2 OCR variant), name: one row per non-blank name; NULL fields have none."""

    def each(column: str, kind: int) -> Column:
        parts = F.split(F.coalesce(F.col(column), F.lit("")), r"\|")
        return F.transform(parts, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))

    one = F.array(F.struct(F.lit(0).alias("kind"), F.col("canonical_name").alias("name")))
    every = F.concat(one, *[each(c, 1) for c in lists], each(errors, 2))
    return products.filter("sku IS NOT NULL").select("sku", "catalog_pos", F.inline(every)).filter(F.trim("name") != "")


def _resolver(index: Callable[[], NameIndex]) -> Callable[[pa.Array], list[tuple | None]]:
    """A function from texts to search results that remembers what it has seen."""
    held: list[NameIndex] = []
    cache: dict[str, tuple | None] = {}

    def resolve(texts: pa.Array) -> list[tuple | None]:
        if not held:
            held.append(index())
        coded = pa.chunked_array([consistent_strings(texts)[0]]).combine_chunks().dictionary_encode()
        keys = [" ".join(words_of(t)) for t in coded.dictionary.to_pylist()]
        if len(cache) > _CACHE:
            cache.clear()
        new = sorted({k for k in keys if k not in cache})
        for a in range(0, len(new), 1000):
            cache.update(zip(new[a : a + 1000], held[0].search(new[a : a + 1000]), strict=True))
        found = [cache[k] for k in keys]
        return [None if i is None else found[i] for i in coded.indices.to_pylist()]

    return resolve


def resolve_values(items: DataFrame, products: DataFrame, key: str = "item_id", text: str = "product_text", max_names: int = MAX_NAMES) -> DataFrame:
    """key, sku of every row: the entry that its text names, or NONE.

    NULL, blank and very long texts name none. Among entries within the
    threshold the nearest wins; then names before aliases before OCR variants,
    then the lower catalog_pos. Repeated rows each give a row; further columns
    are dropped. An empty reference list gives NONE everywhere. Up to max_names
    names travel with the tasks, so that nothing is shuffled; beyond that each
    distinct value meets every shard of the list, and the shards' winners merge.
    """
    names = names_of(products)
    n = names.count()
    items = items.select(key, text)
    if n <= max_names:
        rows = [tuple(r) for r in names.select("sku", "catalog_pos", "kind", "name").collect()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            resolve = _resolver(lambda: NameIndex(_consistent(rows)))
            for batch in batches:
                found = resolve(batch.column(1).cast(pa.string()))
                skus = pa.array([NONE if x is None else x[4] for x in found], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), skus], [key, "sku"])

        return items.mapInArrow(run, f"{key} {items.schema[key].dataType.simpleString()}, sku string")
    return _in_shards(items, names, key, text, -(-n // max_names))


def _consistent(rows: list[tuple]) -> list[tuple]:
    plain = consistent_strings(pa.array([r[3] for r in rows], pa.string()))[0].to_pylist()
    return [(*r[:3], p) for r, p in zip(rows, plain, strict=True)]


def _in_shards(items: DataFrame, names: DataFrame, key: str, text: str, shards: int, salts: int = 32) -> DataFrame:
    values = items.select(F.col(text).alias("value")).filter("value IS NOT NULL").distinct()
    groups = -(-values.count() // GROUP_VALUES)
    bucket = F.pmod(F.xxhash64("value"), F.lit(max(groups, 1)))
    left = values.select("value", bucket.alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = names.withColumn("shard", F.pmod(F.xxhash64("sku"), F.lit(shards)).cast("int")).withColumn(
        "bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(max(groups, 1) - 1).cast("bigint")))
    )

    def search(values: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        rows = list(shard[["sku", "catalog_pos", "kind", "name"]].itertuples(index=False, name=None))
        found = _resolver(lambda: NameIndex(_consistent(rows)))(pa.array(values["value"], pa.string())) if len(values) and rows else []
        hits = [(v, *x) for v, x in zip(values["value"], found) if x is not None]
        return pd.DataFrame(hits, columns=["value", "form", "d", "kind", "catalog_pos", "sku"])

    hits = (
        left.groupBy("shard", "bucket")
        .cogroup(right.groupBy("shard", "bucket"))
        .applyInPandas(search, "value string, form int, d int, kind int, catalog_pos int, sku string")
    )
    won = hits.groupBy("value").agg(F.min_by("sku", F.struct("form", "d", "kind", "catalog_pos", "sku")).alias("sku"))
    # A value may be a third of all rows: its rows are spread over salts, and the winners are repeated for each.
    salted = items.withColumn("salt", F.pmod(F.xxhash64(key, F.monotonically_increasing_id()), F.lit(salts)))
    won = won.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    joined = salted.join(won, (salted[text] == won["value"]) & (salted["salt"] == won["salt"]), "left")
    return joined.select(key, F.coalesce("sku", F.lit(NONE)).alias("sku"))


def inexact_values(items: DataFrame, products: DataFrame, max_names: int = MAX_NAMES) -> DataFrame:
    """item_id, sku of every row whose product_text isn't, character for character, a canonical name or an alias."""
    exact = names_of(products).filter("kind < 2").select(F.col("name").alias("product_text")).distinct()
    if products.count() <= max_names:
        exact = F.broadcast(exact)
    return resolve_values(items.join(exact, "product_text", "left_anti"), products, max_names=max_names)
