"""Quantity and unit extraction from shopping-list lines.

The rules are tried in a fixed order and look at a line's first number or last
tokens. A line is parsed by compiled patterns over an Arrow batch, each
distinct line of a batch once: as column expressions the rules would copy one
another's input until the plan no longer compiles.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from linematch.functions.text import BLANKS, BOM, DEVANAGARI_DIGITS, GUJARATI_DIGITS
from linematch.functions.units import ASCII_UNITS, PARSER_UNITS, spellings

#: Fixed values of the reference behaviour.
FIVE_LETTER = "પ"
SUFFIXES = ["વાળું", "વાળુ", "વાળા", "વાળો", "વાલી", "walu", "wala", "wali"]
POSTPOSITIONS = ["ની", "ના", "નું", "વાળા", "વાળી", "વાળુ", "વાળું", "કા", "की", "के"]

_SPACE = "[ \\t\\n\\x0B\\f\\r]"
_BOUNDARY = "(?=[ \\t\\n\\x0B\\f\\r,\\-)(:]|$)"
_DIGITS = str.maketrans(GUJARATI_DIGITS + DEVANAGARI_DIGITS, "0123456789" * 2, BOM)
_RESULT = (
    StructType()
    .add("product_text", StringType())
    .add("quantity", DoubleType())
    .add("has_quantity", BooleanType())
    .add("unit", StringType())
    .add("has_unit", BooleanType())
    .add("language", StringType())
    .add("ocr_confidence", DoubleType())
)


@dataclass(frozen=True)
class ParserOptions:
    """strict_parity keeps the reference's known quirks.

    Off: a leading letter read as five and the suffix need a word boundary, and
    the trailing multiplier needs a blank before it.
    """

    strict_parity: bool = True


def _alternation(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))


def _unit_pattern() -> str:
    ascii_words = list(spellings(ASCII_UNITS))
    other = [w for w in PARSER_UNITS if w not in ascii_words]
    return f"(?:(?i:{_alternation(ascii_words)})|{_alternation(other)})"


def _unit(token: str | None) -> str | None:
    """Canonical unit of a whole token; None for no unit."""
    return None if token is None else PARSER_UNITS.get(token) or PARSER_UNITS.get(token.lower())


def _value(number: str) -> float | None:
    """Value of a matched number; None for one not above zero."""
    value = 5.0 if number == FIVE_LETTER else float(number.replace(",", "."))
    return value if value > 0 else None


def _cut(text: str) -> tuple[str | None, str]:
    """What stands before the last blank, None if there is none, and the token after it."""
    at = max(text.rfind(c) for c in BLANKS)
    return (None, text) if at < 0 else (text[:at], text[at + 1 :])


def _without_marks(text: str | None) -> str:
    """One trailing run of hyphens and colons taken off, then blanks."""
    return (text or "").strip(BLANKS).rstrip("-:").strip(BLANKS)


def language_of(text: str) -> str:
    """As text.detect_language, for one string."""
    guj = sum("\u0a80" <= c <= "\u0aff" for c in text)
    dev = sum("\u0900" <= c <= "\u097f" for c in text)
    if guj and guj >= dev:
        return "guj"
    return "hin" if dev else "eng" if re.search("[A-Za-z]", text) else "unknown"


class LineParser:
    """The rules with their patterns compiled."""

    def __init__(self, strict: bool = True) -> None:
        unit, five = _unit_pattern(), FIVE_LETTER if strict else f"{FIVE_LETTER}(?={_SPACE}|$)"
        number = f"(?:{five}|[0-9]++(?:[.,][0-9]*+)?)"
        self.strict = strict
        self.lead = re.compile(f"({number})(?:{_SPACE}*+({unit}){_BOUNDARY})?[ \\t\\n\\x0B\\f\\r\\-:,]*+")
        self.postposition = re.compile(f"(?:{_alternation(POSTPOSITIONS)}){_SPACE}++")
        self.number, self.unit = re.compile(number), re.compile(unit)
        self.glued = re.compile(f"(?:{FIVE_LETTER}|[0-9]+(?:[.,][0-9]*)?)(?=({unit})$)" if strict else f"[0-9]+(?:[.,][0-9]*)?(?=({unit})$)")
        self.inner = re.compile(f"(?<={_SPACE}){number}(?={_SPACE}|$)")
        self.unit_here = re.compile(f"({unit}){_BOUNDARY}")

    def parse(self, line: str | None) -> tuple[str, float | None, str | None, str] | None:
        """(product_text, quantity, unit, language), or None for a NULL or blank line."""
        raw = (line or "").removeprefix(BOM).strip(BLANKS)
        if not raw:
            return None
        text = raw.translate(_DIGITS)
        for suffix in SUFFIXES:
            if text.endswith(suffix) and (self.strict or text[: -len(suffix)][-1:] in tuple(BLANKS)):
                text = text[: -len(suffix)]
                break
        return (*self._rules(text.strip(BLANKS)), language_of(raw))

    def _rules(self, text: str) -> tuple[str, float | None, str | None]:
        # The line starts with a number, perhaps followed by a unit.
        quantity = unit = None
        lead = self.lead.match(text)
        if lead and (quantity := _value(lead[1])) is not None:
            unit = _unit(lead[2])
            text = _without_marks(text[lead.end() :])
            post = self.postposition.match(text)
            text = text[post.end() :].strip(BLANKS) if post else text
        else:
            text = _without_marks(text)
        led = quantity is not None

        # It ends in x and a number.
        at = max(text.rfind("x"), text.rfind("X"))
        if at >= 0 and (self.strict or text[:at][-1:] in tuple(BLANKS)):
            times = self._whole_number(text[at + 1 :].lstrip(BLANKS))
            if times is not None:
                return text[:at].strip(BLANKS), times, "piece"

        # Its last token is a number and a unit in one, or a unit after a number.
        before, token = _cut(text)
        glued = self.glued.match(token)
        if glued and (value := _value(glued[0])) is not None:
            return (before or "").strip(BLANKS), value, _unit(glued[1])
        if before is not None and self.unit.fullmatch(token):
            ahead, number = _cut(before.rstrip(BLANKS))
            if (value := self._whole_number(number)) is not None:
                return _without_marks(ahead), value, _unit(token)
        if led:
            return text, quantity, unit

        # Its last token, or one inside, is a number.
        if (value := self._whole_number(token)) is not None:
            return _without_marks(before), value, None
        for number in self.inner.finditer(text):
            if (value := _value(number[0])) is not None:
                rest = text[number.end() :].lstrip(BLANKS)
                named = self.unit_here.match(rest)
                rest = rest[named.end() :].lstrip(BLANKS) if named else rest
                left = text[: number.start()].rstrip(BLANKS)
                return f"{left} {rest}".strip(BLANKS), value, _unit(named[1]) if named else None
        return text, None, None

    def _whole_number(self, token: str) -> float | None:
        return _value(token) if self.number.fullmatch(token) else None


@cache
def _parser(strict: bool) -> LineParser:
    return LineParser(strict)


def _parse_batch(lines: pa.Array, strict: bool) -> pa.Array:
    coded = lines.dictionary_encode()
    found = [_parser(strict).parse(t) for t in coded.dictionary.to_pylist()]
    rows = [None if x is None else (x[0], x[1], x[1] is not None, x[2], x[2] is not None, x[3], None) for x in found]
    names = _RESULT.names
    kinds = [pa.string(), pa.float64(), pa.bool_(), pa.string(), pa.bool_(), pa.string(), pa.float64()]
    columns = [pa.array([None if r is None else r[i] for r in rows], k) for i, k in enumerate(kinds)]
    distinct = pa.StructArray.from_arrays(columns, names, mask=pa.array([r is None for r in rows], pa.bool_()))
    return distinct.take(coded.indices)


# Told to be nondeterministic, so that a filter on the result isn't pushed below it and run again.
@F.arrow_udf(_RESULT)
def _parse_strictly(lines: pa.Array) -> pa.Array:
    return _parse_batch(lines, True)


@F.arrow_udf(_RESULT)
def _parse_loosely(lines: pa.Array) -> pa.Array:
    return _parse_batch(lines, False)


PARSERS = {True: _parse_strictly.asNondeterministic(), False: _parse_loosely.asNondeterministic()}


def parse_line(line: Column, options: ParserOptions = ParserOptions()) -> Column:
    """STRUCT<product_text, quantity, has_quantity, unit, has_unit, language, ocr_confidence>.

    NULL for a NULL or blank line. Quantity and unit are NULL unless the line
    states them; product_text may be empty.
    """
    return PARSERS[options.strict_parity](line)
