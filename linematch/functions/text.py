"""Text scalar functions as JVM-side column expressions.

Every function maps NULL to the value stated in its docstring and never raises
on malformed or very long input. lines_of uses higher-order functions; the
others stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that trimming and line splitting know (C locale).
BLANKS = " \t\n\u000b\f\r"

GUJARATI_DIGITS = "૦૧૨૩૪૫૬૭૮૯"
DEVANAGARI_DIGITS = "०१२३४५६७८९"
BOM = "\ufeff"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: One run of these is one separator: every ASCII mark or control, and U+00A0.
_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F\\xA0]+"


def trim(text: Column) -> Column:
    """Strip BLANKS from both ends; NBSP stays. NULL stays NULL."""
    return F.btrim(text, F.lit(BLANKS))


def normalize_digits(text: Column) -> Column:
    """Gujarati and Devanagari digits to ASCII, every U+FEFF removed. NULL gives ''."""
    return F.translate(
        F.coalesce(text, F.lit("")), GUJARATI_DIGITS + DEVANAGARI_DIGITS + BOM, "0123456789" * 2
    )


def normalize_text(text: Column) -> Column:
    """Digits as above, ASCII letters in lower case, marks as single spaces. NULL gives ''.

    Only ASCII is folded: accented capitals, danda and joiners stay as they are.
    """
    lowered = F.translate(normalize_digits(text), _UPPER, _UPPER.lower())
    return F.btrim(F.regexp_replace(lowered, _SEPARATORS, " "), F.lit(" "))


def detect_language(text: Column) -> Column:
    """'guj', 'hin', 'eng' or 'unknown' by script; one Indic letter outweighs any Latin. NULL: unknown."""
    text = F.coalesce(text, F.lit(""))
    guj = F.regexp_count(text, F.lit("[઀-૿]"))
    dev = F.regexp_count(text, F.lit("[ऀ-ॿ]"))
    return (
        F.when((guj > 0) & (guj >= dev), "guj")
        .when(dev > 0, "hin")
        .when(text.rlike("[A-Za-z]"), "eng")
        .otherwise("unknown")
    )


def has_content(text: Column) -> Column:
    """Whether anything but BLANKS is there (a byte-order mark counts). NULL: false."""
    return F.coalesce(text.rlike("[^ \\t\\n\\x0B\\f\\r]"), F.lit(False))


def lines_of(text: Column) -> Column:
    """The trimmed non-blank lines of a text, in order. NULL gives an empty array."""
    pieces = F.split(F.coalesce(text, F.lit("")), "[\r\n]+")
    return F.filter(F.transform(pieces, trim), lambda line: line != "")
