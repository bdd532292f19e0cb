"""What becomes of an item, given its ranked candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the policy.
UNIDENTIFIED_BELOW = 0.35
AMBIGUOUS_GAP = 0.08
AMBIGUOUS_BELOW = 0.90
CONFIRMED_FROM = 0.80
MODERATE_FROM = 0.50


def status_of(s1: Column, s2: Column) -> Column:
    """confirmed, suggested, ambiguous or unidentified; s2 is NULL for a single candidate, s1 for none."""
    close = F.coalesce((s1 - s2) < AMBIGUOUS_GAP, F.lit(False)) & (s1 < AMBIGUOUS_BELOW)
    return (
        F.when(s1.isNull() | (s1 < UNIDENTIFIED_BELOW), "unidentified")
        .when(close, "ambiguous")
        .when(s1 >= CONFIRMED_FROM, "confirmed")
        .otherwise("suggested")
    )


def reason_of(status: Column, s1: Column) -> Column:
    return (
        F.when(status == "unidentified", "insufficient_confidence")
        .when(status == "ambiguous", "multiple_close_candidates")
        .when(status == "confirmed", "high_confidence_match")
        .when(s1 >= MODERATE_FROM, "moderate_confidence")
        .otherwise("low_confidence_suggestion")
    )


def decide(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: product_id, name, confidence, status, needs_confirmation, reason, candidates.

    candidates: keys, rank, sku, canonical_name, score, confidence_band. Only
    ranked rows (a bounded number per key) are gathered.
    """
    entry = F.struct(
        "rank",
        F.col("sku").alias("product_id"),
        F.col("canonical_name").alias("name"),
        "score",
        F.col("confidence_band").alias("confidence"),
    )
    grouped = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_c"))
    s1, s2 = F.get("_c", F.lit(0))["score"], F.get("_c", F.lit(1))["score"]
    status = status_of(s1, s2)
    known = F.col("status") != "unidentified"
    return (
        grouped.withColumn("_s1", s1)
        .withColumn("status", status)
        .select(
            *keys,
            F.when(known, F.get("_c", F.lit(0))["product_id"]).alias("product_id"),
            F.when(known, F.get("_c", F.lit(0))["name"]).alias("name"),
            F.when(known, F.col("_s1")).otherwise(0.0).alias("confidence"),
            "status",
            (F.col("status") != "confirmed").alias("needs_confirmation"),
            reason_of(F.col("status"), F.col("_s1")).alias("reason"),
            F.when(known, F.transform("_c", lambda x: x.dropFields("rank")))
            .otherwise(F.array().cast("array<struct<product_id:string,name:string,score:double,confidence:string>>"))
            .alias("candidates"),
        )
    )
