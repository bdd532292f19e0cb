"""Catalog CSV text as a DataFrame of products.

The CSV dialect (quotes toggle, doubled quotes stay doubled, a layout per row)
is none that spark.read.csv offers, so lines are split by column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linematch.functions.csv_index import structural_fields
from linematch.functions.text import trim
from linematch.plans.lineage import checkpointed

#: Fixed values of the format.
MAX_COLUMNS = 12
FULL_COLUMNS = 10
SHORT_COLUMNS = 4
MAX_ALIASES = 32
MAX_ERRORS = 32
MAX_UNITS = 16
#: For parity checks only.
PARITY_CAPS = {
    "max_columns": MAX_COLUMNS,
    "max_aliases": MAX_ALIASES,
    "max_errors": MAX_ERRORS,
    "max_units": MAX_UNITS,
}
LIST_MARKS = "[|;\r\n]"


class CatalogError(RuntimeError):
    """A catalog that can't be used; code is CATALOG_LOAD_FAILED or CATALOG_EMPTY."""

    def __init__(self, code: str, detail: str = "") -> None:
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def split_csv(line: Column, limit: int | None = MAX_COLUMNS) -> Column:
    """Columns of a line: commas outside quotes separate; at most limit, None for all. NULL stays NULL."""
    fields = structural_fields(line)
    return fields if limit is None else F.slice(fields, 1, limit)


def unquote(field: Column) -> Column:
    """Trim, take off one pair of quotes, trim again; doubled quotes inside stay."""
    return trim(F.regexp_replace(trim(field), '(?s)^"(.*)"$', "$1"))


def list_field(fields: list[Column], limit: int | None, trimmed: bool = True) -> Column:
    """Non-empty entries of list fields in order, at most limit in all; None for no limit."""
    entries = F.split(F.concat_ws("|", *fields), LIST_MARKS)
    if trimmed:
        entries = F.transform(entries, trim)
    entries = F.filter(entries, lambda x: x != "")
    return entries if limit is None else F.slice(entries, 1, limit)


def is_header(line: Column) -> Column:
    """Whether a feed's first line names columns instead of a product."""
    return line.contains("product_id") | line.contains("sku")


def products_from_lines(
    lines: DataFrame,
    line: str = "line",
    position: str = "line_no",
    feed: str | None = None,
    max_columns: int | None = None,
    max_aliases: int | None = None,
    max_errors: int | None = None,
    max_units: int | None = None,
) -> DataFrame:
    """Physical lines (line, position) to products.

    The line at the lowest position, of each feed if a column names feeds, is a
    header if it names columns; comments, blank lines and lines of fewer than
    four columns are left out (short_lines() gives those). NULL lines are left
    out. Result: catalog_pos, sku, canonical_name, brand, category,
    aliases, ocr_errors, units. Extra columns of the input are dropped. The
    caps are off by default; PARITY_CAPS are those of the reference.
    """
    one = F.lit(0) if feed is None else F.col(feed)
    rows = lines.select(F.col(position).alias("catalog_pos"), F.col(line).alias("_line"), one.alias("_feed"))
    first = rows.groupBy("_feed").agg(F.min("catalog_pos").alias("_first"))
    rows = (
        rows.join(first, "_feed")
        .filter(F.col("_line").isNotNull() & ~F.col("_line").rlike("^(#|\r|\n|$)"))
        .filter(~((F.col("catalog_pos") == F.col("_first")) & is_header(F.col("_line"))))
        .withColumn("_f", F.transform(split_csv(F.col("_line"), max_columns), unquote))
        .filter(F.size("_f") >= SHORT_COLUMNS)
    )
    full = F.size("_f") >= FULL_COLUMNS

    def at(i: int) -> Column:
        return F.coalesce(F.get("_f", F.lit(i)), F.lit(""))

    nothing = F.array().cast("array<string>")
    return rows.select(
        "catalog_pos",
        at(0).alias("sku"),
        at(1).alias("canonical_name"),
        F.when(full, at(2)).otherwise("").alias("brand"),
        F.when(full, at(3)).otherwise(at(2)).alias("category"),
        F.when(full, list_field([at(4), at(5), at(6)], max_aliases))
        .otherwise(list_field([at(3)], max_aliases))
        .alias("aliases"),
        F.when(full, list_field([at(7)], max_errors)).otherwise(nothing).alias("ocr_errors"),
        F.when(full, list_field([at(8), at(9)], max_units, trimmed=False)).otherwise(nothing).alias("units"),
    )


def short_lines(lines: DataFrame, line: str = "line", position: str = "line_no") -> DataFrame:
    """position, line, reason of the lines that products_from_lines leaves out for want of columns."""
    columns = F.size(split_csv(F.col(line), None))
    content = F.col(line).isNotNull() & ~F.col(line).rlike("^(#|\r|\n|$)")
    return lines.filter(content).withColumn("_n", columns).filter(F.col("_n") < SHORT_COLUMNS).select(position, line, F.lit("column_count").alias("reason"))


def read_catalog_csv(spark: SparkSession, path: str, max_products: int | None = None, **caps: int | None) -> DataFrame:
    """Products of CSV files, each with its own header; positions follow the files' names and lines.

    A file is read line by line, in as many tasks as it has blocks. A line's
    number is the lines of the blocks before it and its place in its block, so
    that only one row a block is ever sorted. max_products keeps the first so
    many, caps go to products_from_lines (all off by default).
    """
    try:
        # Written once: the ids must be the same wherever they are used.
        lines = checkpointed(
            spark.read.text(path, lineSep="\n").select(
                "value",
                F.col("_metadata.file_path").alias("feed"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("id"),
            )
        )
    except Exception as e:
        raise CatalogError("CATALOG_LOAD_FAILED", str(e)[:200]) from e
    blocks = lines.groupBy("feed", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("feed").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "feed", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.dense_rank().over(Window.orderBy("feed")).alias("file_no")
    )
    place = F.col("before") + F.col("id") - F.col("first")
    numbered = lines.join(blocks, ["feed", "block"]).select(
        "file_no", F.col("value").alias("line"), ((F.col("file_no").cast("bigint") - 1) * (1 << 40) + place).alias("line_no")
    )
    products = products_from_lines(numbered, feed="file_no", **caps)
    if max_products is not None:
        products = products.orderBy("catalog_pos").limit(max_products)
    return products


def _terms(name: str, kind: str) -> Column:
    # A lambda's default argument would count as one of its variables, so kind is bound here.
    return F.transform(
        F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("ord"), x.alias("term"))
    )


def terms_of(products: DataFrame) -> DataFrame:
    """One row per name, alias, OCR variant and brand: catalog_pos, kind, ord, term. NULL lists count as empty."""
    rows = F.concat(
        F.array(F.struct(F.lit("canonical").alias("kind"), F.lit(0).alias("ord"), F.col("canonical_name").alias("term"))),
        _terms("aliases", "alias"),
        _terms("ocr_errors", "ocr_error"),
        F.filter(
            F.array(F.struct(F.lit("brand").alias("kind"), F.lit(0).alias("ord"), F.col("brand").alias("term"))),
            lambda x: F.coalesce(x["term"], F.lit("")) != "",
        ),
    )
    return products.select("catalog_pos", F.inline(rows))
