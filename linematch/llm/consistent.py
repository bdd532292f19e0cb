"""One consistent form of text: what plain typing of the text as seen would give.

All texts of an Arrow batch are one numpy array of code points. Tables over the
code points say what is unseen, what a character expands to, and which script
it looks like; marks are put in order and composed by passes over the array.
No step is a call per row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from linematch.llm import codepoints as cp

#: Letters that look like Latin ones, and those that only roughly do.
LOOK = {
    "Cyrillic": ("аеорсухѕіјԁԛԝһӏАВЕЅІЈКМНОРСТУХԌԚԜ", "aeopcyxsijdqwhlABESIJKMHOPCTYXGQW"),
    "Greek": ("ονρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovpABEZHIKMNOPTYX"),
    "Armenian": ("օսոհցզՕՍ", "ounhgqOU"),
}
LOOK_ROUGHLY = {"Cyrillic": ("кгп", "krn"), "Greek": ("αικυγη", "aikuyn")}
#: Pairs of letter and sign that stand for one letter (the Unicode Standard's "do not use" spellings).
SPELLED = {
    "आ": "अा", "ऍ": "एॅ", "ऎ": "एॆ", "ऐ": "एे", "ऑ": "अॉ|आॅ", "ऒ": "अॊ|आॆ", "ओ": "अो|आे", "औ": "अौ|आै", "ऄ": "अॆ", "ऊ": "उु", "ॲ": "अॅ",
    "ॉ": "ाॅ", "ॊ": "ाॆ", "ो": "ाे|ेा", "ौ": "ाै|ैा",
    "આ": "અા", "ઍ": "અૅ", "એ": "અે", "ઐ": "અૈ", "ઑ": "અૉ|આૅ", "ઓ": "અો|આે", "ઔ": "અૌ|આૈ", "ૉ": "ાૅ", "ો": "ાે|ેા", "ૌ": "ાૈ|ૈા",
}
#: Letters that take a dot below.
DOTTED = "कखगजडढफકખગજડઢફ"
#: Kinds of compatibility characters that look unlike their expansion.
_OTHER_LOOK = ("<fraction>", "<super>", "<sub>")
_TOP = 0x110000


@lru_cache(1)
def _tables() -> dict[str, np.ndarray]:
    start, size, data = np.zeros(_TOP, np.int32), np.zeros(_TOP, np.uint8), []
    ccc, unseen, space = np.zeros(_TOP, np.uint8), np.zeros(_TOP, bool), np.zeros(_TOP, bool)
    word, script, joins = np.zeros(_TOP, bool), np.zeros(_TOP, np.uint8), np.zeros(_TOP, np.uint8)
    pairs: dict[tuple[int, int], int] = {}
    for i in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]:
        c = chr(i)
        kind, parts = unicodedata.category(c), unicodedata.decomposition(c)
        ccc[i], space[i], word[i] = unicodedata.combining(c), kind == "Zs", kind[0] in "LM"
        unseen[i] = kind == "Cf" and not 0x600 <= i < 0x700 or kind == "Cc" and c not in "\t\n\r" or 0xFE00 <= i < 0xFE10 or 0xE0100 <= i < 0xE01F0
        if parts and not parts.startswith(_OTHER_LOOK):
            full = " " if kind == "Zs" else unicodedata.normalize("NFKD", c)
            if full != c and not (len(full) > 1 and full[0] == " "):
                start[i], size[i] = len(data), len(full)
                data += map(ord, full)
            if parts[0] != "<" and " " in parts and unicodedata.normalize("NFC", c) == c:
                a, b = parts.split()
                pairs[int(a, 16), int(b, 16)] = i
    for i in range(11172):
        lead, vowel, trail = i // 588, i // 28 % 21, i % 28
        key = (0xAC00 + i - trail, 0x11A7 + trail) if trail else (0x1100 + lead, 0x1161 + vowel)
        pairs[key] = 0xAC00 + i
    for whole, spelled in SPELLED.items():
        for two in spelled.split("|"):
            pairs[ord(two[0]), ord(two[1])] = ord(whole)
    for i in (0x1680, 0x180E):
        start[i], size[i] = len(data), 1
        data.append(32)
        unseen[i] = False
    for a, b in ((0x900, 0x97F), (0x980, 0xDFF)):
        joins[a : b + 1] = np.arange(a, b + 1) >> 7
    keys = np.array(sorted(a << 21 | b for a, b in pairs), np.int64)
    names = {"LATIN": 1, "CYRILLIC": 2, "GREEK": 3, "ARMENIAN": 4}
    for i in [*range(0x41, 0x590), *range(0x1E00, 0x2000), *range(0x2DE0, 0x2E00), *range(0xA640, 0xA6A0)]:
        if word[i] and (name := unicodedata.name(chr(i), "").split()):
            script[i] = names.get(name[0], 0)
    look, firmly, back = np.zeros(_TOP, np.uint32), np.zeros(_TOP, bool), np.zeros((5, 128), np.uint32)
    for table, firm in ((LOOK_ROUGHLY, False), (LOOK, True)):
        for name, (here, there) in table.items():
            for a, b in zip(here, there, strict=True):
                look[ord(a)], firmly[ord(a)] = ord(b), firm
                back[names[name.upper()], ord(b)] = ord(a)
    # A capital looks Latin by itself, but a word of such capitals is only taken for Latin if its small letters look it too.
    small = np.array([firmly[ord(s)] if len(s := chr(i).lower()) == 1 else False for i in range(0x600)] + [False] * (_TOP - 0x600))
    sign, bindu, nukta, base, dotted = (np.zeros(_TOP, bool) for _ in range(5))
    dotted[list(map(ord, DOTTED))] = True
    for block in (0x900, 0xA80):
        sign[block + 0x3E : block + 0x4D] = True
        bindu[block : block + 4] = True
        nukta[block + 0x3C] = True
        base[block + 0x15 : block + 0x3A] = True
    second = np.zeros(_TOP, bool)
    second[[b for _, b in pairs]] = True
    return {
        "start": start, "size": size, "data": np.array(data, np.uint32), "ccc": ccc, "unseen": unseen, "word": word, "script": script, "joins": joins,
        "keys": keys, "whole": np.array([pairs[int(k) >> 21, int(k) & 0x1FFFFF] for k in keys], np.uint32), "second": second,
        "look": look, "firmly": firmly, "small": small, "back": back, "sign": sign, "bindu": bindu, "nukta": nukta, "base": base, "dotted": dotted,
    }


def _without_unseen(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unseen characters go, but for joiners that shape a letter: between a virama and a letter of its script, or between pictures."""
    t = _tables()
    unseen = t["unseen"][cps]
    if not unseen.any():
        return cps, offsets
    joiner = np.flatnonzero((cps == 0x200C) | (cps == 0x200D))
    if len(joiner):
        index, n = np.arange(len(cps)), len(cps)
        before = np.maximum.accumulate(np.where(unseen, -1, index))[joiner]
        after = np.minimum.accumulate(np.where(unseen, n, index)[::-1])[::-1][joiner]
        row = cp.row_of(offsets)
        inside = (before >= 0) & (after < n)
        b, a = np.where(inside, before, 0), np.where(inside, after, 0)
        inside &= (row[b] == row[joiner]) & (row[a] == row[joiner])
        first = ~np.concatenate([[False], (joiner[1:] - joiner[:-1] == 1)])  # one joiner is enough
        block = t["joins"]
        shaping = (t["ccc"][cps[b]] == 9) & t["word"][cps[a]] & (block[cps[b]] == block[cps[a]]) & (block[cps[b]] > 0)
        picture = (cps[b] >= 0x2190) & (cps[a] >= 0x2190) & ~t["word"][cps[b]] & ~t["word"][cps[a]]
        unseen[joiner[inside & first & (shaping | picture)]] = False
    return cp.kept(cps, offsets, ~unseen)


def _ordered(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks in canonical order; a dot below before the vowel sign, a nasal mark after it."""
    t = _tables()
    ccc = t["ccc"][cps]
    if ((ccc[1:] > 0) & (ccc[1:] < ccc[:-1])).any():
        starter = ccc == 0
        starter[offsets[:-1][offsets[:-1] < len(cps)]] = True
        cps = cps[np.argsort(np.cumsum(starter) * 256 + np.where(ccc == 0, 0, ccc), kind="stable")]
    if len(cps) < 3:
        return cps
    here, next_, row = cps[1:-1], cps[2:], cp.row_of(offsets)
    after = np.concatenate([t["sign"][cps[3:]] & (row[3:] == row[1:-2]), [False]])
    base = t["base"][cps[:-2]] | t["nukta"][cps[:-2]]
    swap = (row[:-2] == row[2:]) & base & ~after & ((t["bindu"][here] & t["sign"][next_]) | (t["sign"][here] & t["nukta"][next_] & t["dotted"][cps[:-2]]))
    at = np.flatnonzero(swap) + 1
    if len(at):
        cps = cps.copy()
        cps[at], cps[at + 1] = cps[at + 1], cps[at]
    return cps


def _composed(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks composed with the letter they follow, all first ones of a pass at once."""
    t = _tables()
    while t["second"][cps].any():
        ccc, row = t["ccc"][cps], cp.row_of(offsets)
        starter = np.maximum.accumulate(np.where(ccc == 0, np.arange(len(cps)), -1))
        at = np.flatnonzero(t["second"][cps])
        at = at[at > 0]
        s = np.where(ccc[at] == 0, at - 1, starter[at - 1])
        free = (s >= 0) & (row[s] == row[at]) & (ccc[s] == 0) & ((s == at - 1) | (ccc[at] > ccc[at - 1]))
        at, s = at[free], s[free]
        key = cps[s].astype(np.int64) << 21 | cps[at]
        found = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        hit = t["keys"][found] == key
        at, s, found = at[hit], s[hit], found[hit]
        first = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
        first &= ~np.isin(s, at)  # a sign that is composed itself comes first
        if not first.any():
            break
        cps = cps.copy()
        cps[s[first]] = t["whole"][found[first]]
        keep = np.ones(len(cps), bool)
        keep[at[first]] = False
        cps, offsets = cp.kept(cps, offsets, keep)
    return cps, offsets


def _one_script(cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Look-alike letters as letters of the script of their word.

    A word of another script, with a letter that looks like no Latin one, is
    proper; Latin look-alikes in it become letters of that script. In every
    other word look-alikes become Latin, unless its text has a proper word of
    the same script and the word has no Latin letter.
    """
    t = _tables()
    script = t["script"][cps]
    if not (script > 1).any():
        return cps
    row, inside = cp.row_of(offsets), t["word"][cps]
    fresh = inside & ~np.concatenate([[False], inside[:-1] & (row[1:] == row[:-1])])
    word = np.where(inside, np.cumsum(fresh), 0)
    n = int(word.max()) + 1
    count = lambda where: np.bincount(word[where], minlength=n)
    latin, look = count(script == 1), t["look"][cps] > 0
    cps = cps.copy()
    for code in (2, 3, 4):
        mine = script == code
        if not mine.any():
            continue
        other = count(mine & ~(t["firmly"][cps] & t["small"][cps]) & ((latin[word] == 0) | ~look))
        all_mine = count(mine)
        returns = count((script == 1) & (np.where(cps < 128, t["back"][code][np.minimum(cps, 127)], 0) > 0))
        proper = (other > 0) & ((latin == 0) | ((latin == returns) & (all_mine > latin)))
        with_proper = np.zeros(len(offsets), bool)
        with_proper[row[mine & proper[word]]] = True
        to_latin = mine & look & ~proper[word] & ((latin[word] > 0) | ~with_proper[row])
        to_mine = (script == 1) & proper[word]
        cps[to_latin] = t["look"][cps[to_latin]]
        cps[to_mine] = t["back"][code][cps[to_mine]]
    return cps


def consistent_codepoints(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The consistent form of all strings, and for each whether it differs from the given one."""
    t = _tables()
    plain = cps < 0x80
    odd = np.concatenate([[0], np.cumsum(~plain | t["unseen"][cps])])
    rows = np.flatnonzero(odd[offsets[1:]] > odd[offsets[:-1]])
    changed = np.zeros(len(offsets) - 1, bool)
    if not len(rows):
        return cps, offsets, changed
    given = cp.taken(cps, offsets, rows)
    x, o = _without_unseen(*given)
    x, o = cp.expanded(x, o, t["start"], t["size"], t["data"])
    x = _ordered(x, o)
    x = _one_script(x, o)
    x, o = _composed(x, o)
    changed[rows] = cp.differing(given, (x, o))
    # The changed strings go where the given ones were.
    sizes = np.diff(offsets).copy()
    sizes[rows] = np.diff(o)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(ends[-1], np.uint32)
    touched = np.zeros(len(sizes), bool)
    touched[rows] = True
    into = np.repeat(touched, sizes)
    out[into] = x
    out[~into] = cps[~np.repeat(touched, np.diff(offsets))]
    return out, ends, changed


def consistent_strings(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The consistent form of an Arrow string array, and whether each differs; NULL stays NULL."""
    cps, offsets, changed = consistent_codepoints(*cp.decode(strings))
    return cp.encode(cps, offsets, np.asarray(strings.is_null())), changed


def with_consistent(df: DataFrame, columns: list[str], plain: str = "{}_plain", differs: str = "{}_differs") -> DataFrame:
    """df with the consistent form of each text column and whether it differs from the text.

    NULL gives NULL and false, empty text stays empty, texts of any length are
    taken whole, and repeated rows and further columns stay as they are. Names
    that are taken already raise ValueError.
    """
    new = [(plain.format(c), differs.format(c)) for c in columns]
    clash = {x for pair in new for x in pair} & set(df.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    fields = [f for p, d in new for f in (StructField(p, StringType()), StructField(d, BooleanType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays, names = list(batch.columns), list(batch.schema.names)
            for c, pair in zip(columns, new, strict=True):
                text, changed = consistent_strings(batch.column(batch.schema.get_field_index(c)))
                arrays += [text, pa.array(changed)]
                names += pair
            yield pa.RecordBatch.from_arrays(arrays, names)

    return df.mapInArrow(run, StructType([*df.schema.fields, *fields]))


def inconsistent_fields(items: DataFrame, key: str = "item_id", columns: tuple[str, ...] = ("product_text", "raw_text")) -> DataFrame:
    """key and field_name of every text that is not in the consistent form."""
    checked = with_consistent(items.select(key, *columns), list(columns))
    names = [F.when(F.col(f"{c}_differs"), F.lit(c)) for c in columns]
    return checked.select(key, F.explode(F.array_compact(F.array(*names))).alias("field_name"))
