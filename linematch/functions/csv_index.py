"""Structural index of CSV lines, a batch at a time.

The lines of an Arrow batch are one numpy array of bytes. A mask of the double
quotes and its running count give the parity at every byte; commas at even
parity separate, and the lines' ends close the last fields. Trimming, quoting
and type checks are array operations over all fields of the batch at once, so
a line's length costs neither stack nor a call.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructType

_QUOTE, _COMMA = 0x22, 0x2C
_FIELDS = ArrayType(StringType())
_CHECKED = StructType().add("fields", _FIELDS).add("broken", BooleanType()).add("sku_fits", BooleanType()).add("name_fits", BooleanType())
_BLANKS = np.zeros(256, bool)
_BLANKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


@dataclass
class Fields:
    """Fields of lines: field i is raw[start[i]:end[i]]; line k has the fields first[k] to first[k + 1]."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    nulls: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def trimmed(self) -> "Fields":
        """The fields without blanks around them."""
        n = len(self.raw)
        ink, index = ~_BLANKS[self.raw], np.arange(n)
        after = np.append(np.minimum.accumulate(np.where(ink, index, n)[::-1])[::-1], n)
        before = np.append(np.maximum.accumulate(np.where(ink, index, -1)), -1)
        start = np.minimum(after[self.start], self.end)
        end = np.maximum(np.where(self.end > 0, before[self.end - 1] + 1, 0), start)
        return Fields(self.raw, start, end, self.first, self.nulls)

    def quoting(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether each field has a quote, and whether it is wholly within one pair with inner ones doubled."""
        at = np.flatnonzero(self.raw == _QUOTE)
        before = np.searchsorted(at, self.start), np.searchsorted(at, self.end)
        many = before[1] - before[0]
        size = self.end - self.start
        padded = np.append(self.raw, 0)
        edges = (size >= 2) & (padded[self.start] == _QUOTE) & (padded[np.maximum(self.end - 1, 0)] == _QUOTE)
        # Inner quotes must come as pairs of neighbours: the first and second, the third and fourth, and so on.
        field = np.repeat(np.arange(len(many)), many)
        place = np.arange(len(field)) - np.repeat(np.cumsum(many) - many, many)
        mine = np.repeat(before[0], many) + place
        opens = (place % 2 == 1) & (place < many[field] - 1) if len(field) else np.zeros(0, bool)
        apart = np.zeros(len(many), bool)
        lone = mine[opens]
        wrong = at[np.minimum(lone + 1, len(at) - 1)] != at[lone] + 1 if len(lone) else np.zeros(0, bool)
        apart[field[opens][wrong]] = True
        return many > 0, edges & (many % 2 == 0) & ~apart

    def strings(self) -> pa.Array:
        """The fields as an Arrow array of strings."""
        start, size = self.start, self.end - self.start
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        data = self.raw[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)]
        return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data)]).cast(pa.string())

    def lists(self, values: pa.Array) -> pa.Array:
        """One list for each line of values, which are one for each field; NULL lines have NULL."""
        offsets = pa.array(np.append(self.first[:-1], self.first[-1]), pa.int32(), mask=np.append(self.nulls, False))
        return pa.ListArray.from_arrays(offsets, values)


def index(lines: pa.Array) -> Fields:
    """Where the fields of each line are, blanks and quotes as they stand. A NULL line has no field."""
    nulls = np.asarray(lines.is_null())
    text = lines.cast(pa.large_string())
    n = len(text)
    _, ends, data = text.buffers()
    offsets = np.frombuffer(ends, np.int64, n + 1, text.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and n else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    quotes = np.concatenate([[0], np.cumsum(raw == _QUOTE)])
    commas = np.flatnonzero(raw == _COMMA)
    line = np.searchsorted(offsets, commas, "right") - 1
    outside = (quotes[commas] - quotes[offsets[line]]) % 2 == 0
    commas, line = commas[outside], line[outside]
    counts = np.bincount(line, minlength=n) + ~nulls
    first = np.concatenate([[0], np.cumsum(counts)])
    start, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    start[first[:-1][~nulls]] = offsets[:-1][~nulls]
    end[first[1:][~nulls] - 1] = offsets[1:][~nulls]
    place = np.arange(len(commas)) + line - np.concatenate([[0], np.cumsum(nulls)])[line]  # each line before has one field more than commas
    end[place], start[place + 1] = commas, commas + 1
    return Fields(raw, start, end, first, nulls)


def _plain(fields: Fields, enclosed: np.ndarray) -> pa.Array:
    """Trimmed fields without their enclosing quotes, inner ones single, trimmed again."""
    inner = Fields(fields.raw, fields.start + enclosed, fields.end - enclosed, fields.first, fields.nulls)
    again = inner.trimmed()
    inner.start, inner.end = np.where(enclosed, again.start, inner.start), np.where(enclosed, again.end, inner.end)
    values = inner.strings()
    doubled = pc.and_(pa.array(enclosed), pc.match_substring(values, '""'))
    return pc.if_else(doubled, pc.replace_substring(values, '""', '"'), values)


def _nth(fields: Fields, values: pa.Array, n: int) -> pa.Array:
    """Each line's nth value, empty where there is none."""
    at = pa.array(fields.first[:-1] + n, mask=fields.counts <= n)
    return pc.fill_null(values.take(at), "")


@F.arrow_udf(_FIELDS)
def structural_fields(lines: pa.Array) -> pa.Array:
    """Fields with their blanks and quotes as they stand. NULL stays NULL."""
    fields = index(lines)
    return fields.lists(fields.strings())


@F.arrow_udf(_CHECKED)
def checked_fields(lines: pa.Array) -> pa.Array:
    """Plain fields of each line, whether any has a quote without being enclosed, and whether the first two fit.

    sku_fits: two to six capital letters and then three to five digits.
    name_fits: a letter, no stand-in for "no value", no control or replacement
    character. NULL lines have NULL fields and fit nothing.
    """
    fields = index(lines).trimmed()
    quoted, enclosed = fields.quoting()
    values = _plain(fields, enclosed)
    wrong = np.concatenate([[0], np.cumsum(quoted & ~enclosed)])
    broken = wrong[fields.first[1:]] > wrong[fields.first[:-1]]
    sku, name = (_nth(fields, values, n) for n in (0, 1))
    return pa.StructArray.from_arrays(
        [fields.lists(values), pa.array(broken), pa.array(_sku_fits(sku)), _name_fits(name)],
        ["fields", "broken", "sku_fits", "name_fits"],
    )


def _sku_fits(skus: pa.Array) -> np.ndarray:
    f = index(pc.replace_substring(skus, ",", ";"))  # one field each
    letters = np.concatenate([[0], np.cumsum((f.raw >= 0x41) & (f.raw <= 0x5A))])
    digits = np.concatenate([[0], np.cumsum((f.raw >= 0x30) & (f.raw <= 0x39))])
    size, many, tail = f.end - f.start, letters[f.end] - letters[f.start], digits[f.end] - digits[f.start]
    lead = letters[np.minimum(f.start + many, f.end)] - letters[f.start]
    return (many + tail == size) & (lead == many) & (many >= 2) & (many <= 6) & (tail >= 3) & (tail <= 5)


#: Names that stand for "no value", in lower case; those without a letter need no mention.
NO_VALUE = [
    "null", "none", "nil", "nan", "na", "n/a", "n.a.", "n.a", "#n/a", "#null!", "#name?", "#value!", "#ref!", "#div/0!",
    "unknown", "undefined", "tbd", "tba", "tbc", "missing", "void", "empty", "blank", "no name", "no value", "not available",
    "not applicable", "not known", "to be decided", "(null)", "<null>",
]


def _name_fits(names: pa.Array) -> pa.Array:
    stands_in = pc.is_in(pc.utf8_lower(names), pa.array(NO_VALUE))
    bad = pc.or_(stands_in, pc.match_substring_regex(names, "[\\p{Cc}�]"))
    return pc.and_not(pc.match_substring_regex(names, "\\p{L}"), bad)
