"""Similarity measures as column expressions over code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linematch.functions.text import normalize_text

#: Fixed values of the measure.
LENGTH_BOUND = 0.20
CHAR_WEIGHT = 0.65
TOKEN_WEIGHT = 0.35
HIGH_BAND = 0.80
MEDIUM_BAND = 0.50


def char_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, over code points; NULL gives 0.

    Where the lengths alone keep the result under LENGTH_BOUND, that upper
    bound is the result. Two empty texts give 1, one empty text gives 0.
    """
    la, lb = F.length(a), F.length(b)
    longer = F.greatest(la, lb).cast("double")
    bound = F.lit(1.0) - F.abs(la - lb).cast("double") / longer
    return (
        F.when(a.isNull() | b.isNull(), 0.0)
        .when(a == b, 1.0)
        .when((a == "") | (b == ""), 0.0)
        .when(bound < LENGTH_BOUND, bound)
        .otherwise(F.lit(1.0) - F.levenshtein(a, b).cast("double") / longer)
    )


def token_overlap_normalized(a: Column, b: Column) -> Column:
    """Share of a's tokens (repeats counted) found in b; both already normalised. Empty gives 0."""
    ours, theirs = F.split(a, " "), F.split(b, " ")
    shared = F.size(F.filter(ours, lambda t: F.array_contains(theirs, t)))
    return (
        F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0)
        .when(a == b, 1.0)
        .otherwise(shared.cast("double") / F.size(ours).cast("double"))
    )


def token_overlap(a: Column, b: Column) -> Column:
    """token_overlap_normalized of the normalised texts; asymmetric."""
    return token_overlap_normalized(normalize_text(a), normalize_text(b))


def hybrid_normalized(a: Column, b: Column) -> Column:
    """Weighted characters and tokens of texts already normalised; equal texts give 1."""
    return F.when(a == b, 1.0).otherwise(
        F.lit(CHAR_WEIGHT) * char_similarity(a, b) + F.lit(TOKEN_WEIGHT) * token_overlap_normalized(a, b)
    )


def hybrid_similarity(a: Column, b: Column) -> Column:
    """hybrid_normalized of the normalised texts; NULL gives 0, two empty texts give 1."""
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(hybrid_normalized(normalize_text(a), normalize_text(b)))


def confidence_band(score: Column) -> Column:
    """HIGH, MEDIUM or LOW; NULL counts as LOW."""
    return F.when(score >= HIGH_BAND, "HIGH").when(score >= MEDIUM_BAND, "MEDIUM").otherwise("LOW")
