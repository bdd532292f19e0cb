"""Catalog feeds line by line: why a line cannot be loaded, and the entries of all others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linematch.functions.csv_index import checked_fields
from linematch.functions.text import has_content
from linematch.sources.catalog import FULL_COLUMNS, list_field

def classified_lines(lines: DataFrame) -> DataFrame:
    """Every line after line 1, neither blank nor a comment: feed_id, line_no, fields, columns, reason.

    columns is the header's number of columns; reason is the first that
    applies, NULL for a line that can be loaded. The lines of a feed without
    line 1 are held against the full layout.
    """
    indexed = lines.filter(((F.col("line_no") == 1) | has_content(F.col("line"))) & F.col("line").isNotNull()).select(
        "feed_id", "line_no", F.col("line").startswith("#").alias("remark"), checked_fields(F.col("line")).alias("i")
    )
    headers = indexed.filter("line_no = 1").select("feed_id", F.size("i.fields").alias("columns"))
    body = (
        indexed.filter((F.col("line_no") > 1) & ~F.col("remark"))
        .join(headers, "feed_id", "left")
        .withColumn("columns", F.coalesce("columns", F.lit(FULL_COLUMNS)))
    )
    reason = (
        F.when(F.col("i.broken"), "broken_quote")
        .when(F.size("i.fields") != F.col("columns"), "column_count")
        .when(~F.col("i.sku_fits"), "bad_sku")
        .when(~F.col("i.name_fits"), "bad_name")
    )
    return body.select("feed_id", "line_no", "i.fields", "columns", reason.alias("reason"))


def rejected_lines(lines: DataFrame) -> DataFrame:
    """feed_id, line_no, reason of every line that cannot be loaded."""
    return classified_lines(lines).filter("reason IS NOT NULL").select("feed_id", "line_no", "reason")


def loaded_entries(lines: DataFrame) -> DataFrame:
    """feed_id, line_no and the entry of every other line; lists hold all their values."""
    full = F.col("columns") >= FULL_COLUMNS

    def at(i: int) -> Column:
        return F.coalesce(F.get("fields", F.lit(i)), F.lit(""))

    def values(*places: int) -> Column:
        return list_field([at(i) for i in places], None)

    nothing = F.array().cast("array<string>")
    return (
        classified_lines(lines)
        .filter("reason IS NULL")
        .select(
            "feed_id",
            "line_no",
            at(0).alias("sku"),
            at(1).alias("canonical_name"),
            F.when(full, at(2)).otherwise("").alias("brand"),
            F.when(full, at(3)).otherwise(at(2)).alias("category"),
            F.when(full, values(4, 5, 6)).otherwise(values(3)).alias("aliases"),
            F.when(full, values(7)).otherwise(nothing).alias("ocr_errors"),
            F.when(full, values(8)).otherwise(nothing).alias("units"),
            F.when(full, values(9)).otherwise(nothing).alias("pack_sizes"),
        )
    )
