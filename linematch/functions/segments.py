"""Several values in one string, segmented with a dictionary of known values.

Marks outside quotes and numbers cut a field into atoms. A multi-pattern
automaton finds every known whole value in one pass over the field; dynamic
programming over the atoms then picks the cover of least cost, in which a known
value is cheaper than the atoms it spans, so that marks inside it do not
separate. Patterns have no nested repeats over groups that could go back, so a
field costs time in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Marks that separate; a comma or slash between two digits belongs to a number.
MARKS = ",|;/¦•；，、\t\n\r\x0b\x0c\x85\u2028\u2029"
#: Known values that a broadcast dictionary may hold; more are found by a join, with equal results.
DICTIONARY_VALUES = 500_000
#: Spans that a task holds before it passes them on.
SPAN_ROWS = 50_000
#: Cost of an atom, of a known value, and of nothing between two marks.
_ATOM, _KNOWN = 2, 1

_FREE = "".join(c for c in MARKS if c not in ",/")
_END = re.compile(rf"[{re.escape(_FREE)}]|(?<!\d)[,/]|[,/](?!\d)")
_QUOTED = re.compile(r'"([^"]*(?:""[^"]*)*)"(?!")')
_AROUND = {"[": "]", "{": "}"}


def automaton(values: list[str]):
    """An automaton over values in lower case, or None for no value."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for value in values:
        value = value.strip().lower()
        if value:
            machine.add_word(value, len(value))
    if not len(machine):
        return None
    machine.make_automaton()
    return machine


def _atoms(text: str) -> list[tuple[int, int, str]]:
    """(start, end, value) of every non-empty piece between marks; a quoted piece is one atom without its quotes."""
    found, at, n = [], 0, len(text)
    while at < n:
        while at < n and (text[at].isspace() or text[at] in MARKS):
            at += 1
        if at == n:
            break
        quoted = _QUOTED.match(text, at)
        if quoted:
            after = quoted.end()
            while after < n and text[after].isspace() and text[after] not in MARKS:
                after += 1
            if after == n or text[after] in MARKS:
                value = quoted[1].replace('""', '"').strip()
                if value:
                    found.append((at, quoted.end(), value))
                at = after + 1
                continue
        end = _END.search(text, at)
        stop = end.start() if end else n
        value = text[at:stop].strip()
        found.append((at, at + len(value), value))
        at = stop + 1
    return found


def _known_spans(text: str, atoms: list[tuple[int, int, str]], known) -> list[tuple[int, int]]:
    """The first and the last atom of every known value that begins and ends with one."""
    first = {start: i for i, (start, _, _) in enumerate(atoms)}
    last = {end: i for i, (_, end, _) in enumerate(atoms)}
    spans = []
    low = text.lower()
    if len(low) == len(text):  # else places would differ
        for at, size in known.iter(low):
            i, j = first.get(at + 1 - size), last.get(at + 1)
            if i is not None and j is not None:
                spans.append((i, j))
    return spans


def _cover(text: str, atoms: list[tuple[int, int, str]], spans: list[tuple[int, int]]) -> list[str]:
    """The values of the cheapest cover of the atoms, spans being known; of equal ones that with the longer last value."""
    ends_here: dict[int, list[int]] = {}
    for i, j in spans:
        ends_here.setdefault(j, []).append(i)
    best: list[tuple[int, int]] = [(0, 0)]
    for j in range(len(atoms)):
        option = (best[j][0] + _ATOM, j)
        for i in ends_here.get(j, ()):
            option = min(option, (best[i][0] + _KNOWN, i))
        best.append(option)
    values, j = [], len(atoms)
    while j:
        i = best[j][1]
        values.append(atoms[i][2] if j - i == 1 else text[atoms[i][0] : atoms[j - 1][1]])
        j = i
    return values[::-1]


def _read(field: str | None) -> tuple[str, list[tuple[int, int, str]]]:
    """A field without what encloses it, and its atoms."""
    text = (field or "").strip()
    if len(text) >= 2 and _AROUND.get(text[0]) == text[-1]:
        text = text[1:-1]
    return text, _atoms(text)


def values_of(field: str | None, known=None) -> list[str]:
    """The non-empty values of a field in order, trimmed, quotes taken off; known is an automaton of whole values."""
    text, atoms = _read(field)
    return _cover(text, atoms, _known_spans(text, atoms, known) if known is not None else [])


def known_values(products: DataFrame) -> DataFrame:
    """value: every name, alias, OCR variant and unit of a catalog, once."""
    names = ("aliases_en", "aliases_gu", "aliases_hi", "ocr_errors", "units", "pack_sizes")
    lists = [F.split(F.coalesce(F.col(c), F.lit("")), r"\|") for c in names]
    every = F.concat(F.array(F.coalesce("canonical_name", F.lit(""))), *lists)
    return products.select(F.explode(every).alias("value")).select(F.lower(F.trim("value")).alias("value")).filter("value <> ''").distinct()


def _spans_by_join(held: DataFrame, known: DataFrame) -> DataFrame:
    """held with _spans, what _known_spans() finds in _field as first atom << 32 | last atom, or NULL; no task holds the known values.

    Every run of atoms that is as long as some known value is looked up among
    them. Fields of one atom are left out: known or not, it is the value.
    """

    @F.pandas_udf(StringType())
    def key(values: pd.Series) -> pd.Series:
        return values.str.strip().str.lower()

    keys = known.select(key("value").alias("_key")).filter("_key <> ''").distinct()
    sizes = {r.size for r in keys.select(F.length("_key").alias("size")).distinct().collect()}  # no more than the longest has characters
    longest = max(sizes, default=0)

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple[str, int, str]] = []
        for batch in batches:
            for name, field in zip(batch["_id"], batch["_field"], strict=True):
                text, atoms = _read(field)
                low = text.lower()
                if len(atoms) < 2 or len(low) != len(text):
                    continue
                for i, (start, _, _) in enumerate(atoms):
                    for j in range(i, len(atoms)):
                        end = atoms[j][1]
                        if end - start > longest:
                            break
                        if end - start in sizes:
                            rows.append((name, i << 32 | j, low[start:end]))
                    if len(rows) >= SPAN_ROWS:
                        yield pd.DataFrame(rows, columns=["_id", "_span", "_key"])
                        rows = []
        yield pd.DataFrame(rows, columns=["_id", "_span", "_key"])

    held = held.withColumn("_id", F.sha2("_field", 256))
    spans = held.select("_id", "_field").distinct().mapInPandas(runs, "_id string, _span bigint, _key string")
    found = spans.join(keys, "_key", "left_semi").groupBy("_id").agg(F.collect_list("_span").alias("_spans"))
    return held.join(found, "_id", "left")


def _segmented(held: DataFrame, products: DataFrame | None) -> DataFrame:
    """held with _values, the values of _field, for which the values of the catalog products are known, however many they are."""
    known = known_values(products) if products is not None else None
    if known is not None and known.count() > DICTIONARY_VALUES:

        @F.pandas_udf(ArrayType(StringType()))
        def covered(fields: pd.Series, found: pd.Series) -> pd.Series:
            def values(field: str, spans) -> list[str]:
                pairs = [(s >> 32, s & 0xFFFFFFFF) for s in map(int, spans if spans is not None else ())]
                return _cover(*_read(field), pairs)

            return pd.Series([values(f, s) for f, s in zip(fields, found, strict=True)], dtype=object)

        return _spans_by_join(held, known).withColumn("_values", covered("_field", "_spans"))

    words = [r.value for r in known.collect()] if known is not None else []
    machines: list = []

    @F.pandas_udf(ArrayType(StringType()))
    def segments(fields: pd.Series) -> pd.Series:
        if not machines:
            machines.append(automaton(words))
        return fields.map(lambda f: values_of(f, machines[0]))

    return held.withColumn("_values", segments("_field"))


def field_values(
    entries: DataFrame, names: tuple[str, ...] = ("aliases", "ocr_errors", "units"), products: DataFrame | None = None
) -> DataFrame:
    """One row per value of each field: entry_id, field_name, pos (from 1), item_value, n_values.

    NULL and empty fields give no row, repeated rows and equal values stay,
    further columns are dropped. products is the catalog whose values are known.
    """
    each = entries.select(
        "entry_id",
        F.inline(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(n).alias("_field")) for n in names])),
    )
    held = _segmented(each.filter("_field IS NOT NULL"), products)
    return held.select(
        "entry_id", "field_name", F.size("_values").alias("n_values"), F.posexplode("_values").alias("pos", "item_value")
    ).select("entry_id", "field_name", (F.col("pos") + 1).alias("pos"), "item_value", "n_values")


def packed_values(entries: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """The values of fields that hold two or more."""
    return field_values(entries, products=products).filter("n_values >= 2").drop("n_values")
