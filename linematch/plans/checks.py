"""Queries of SURVEY 7.3 over whole tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linematch.functions import similarity, text
from linematch.functions.parser import parse_line
from linematch.operators.matcher import match_items
from linematch.plans.pipeline import match_parsed, parse_items, process_documents, split_lines, to_json_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(make):
        QUERIES[make.__name__] = make
        if sql is not None:
            ORACLES[make.__name__] = sql
        return make

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a catalog; every row is kept."""
    no = F.array().cast("array<string>")
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("catalog_pos"),
        F.col("p_partkey").cast("string").alias("sku"),
        F.col("p_name").alias("canonical_name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        no.alias("aliases"),
        no.alias("ocr_errors"),
        F.array(F.lit("kg")).alias("units"),
    )


def listed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """catalog_products with its lists split; NULL stays NULL."""
    def values(*names):
        return F.filter(F.split(F.concat_ws("|", *names), r"\|"), lambda x: x != "")

    return _table(spark, sf_dir, "catalog_products").select(
        "catalog_pos", "sku", "canonical_name", "brand", "category",
        values("aliases_en", "aliases_gu", "aliases_hi").alias("aliases"),
        F.split("ocr_errors", r"\|").alias("ocr_errors"),
        values("units", "pack_sizes").alias("units"),
    )


def lines_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list line for every row of lineitem: 'name quantity kg'."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    return _table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(
        "l_orderkey",
        "l_linenumber",
        "p_name",
        "l_quantity",
        F.concat_ws(" ", "p_name", F.col("l_quantity").cast("int").cast("string"), F.lit("kg")).alias("raw_text"),
    )


def match_exact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: every line of lineitem, parsed and matched against part."""
    lines = lines_of_orders(spark, sf_dir).select("l_orderkey", "l_linenumber", "raw_text")
    return match_parsed(parse_items(lines), part_catalog(spark, sf_dir)).select(
        "l_orderkey", "l_linenumber", "product_text", "quantity", "unit", "product_id", F.round("confidence", 6).alias("confidence"), "status"
    )


@_query("SELECT p_partkey, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')) AS brand FROM part")
def normalize_text_brand(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", text.normalize_text(F.col("p_brand")).alias("brand"))


@_query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS digits FROM orders")
def normalize_digits_guj(spark, sf_dir):
    native = F.translate(F.col("o_orderkey").cast("string"), "0123456789", text.GUJARATI_DIGITS)
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.normalize_digits(native).alias("digits"))


@_query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS digits FROM orders")
def normalize_digits_dev(spark, sf_dir):
    native = F.translate(F.col("o_orderkey").cast("string"), "0123456789", text.DEVANAGARI_DIGITS)
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.normalize_digits(native).alias("digits"))


def _parsed(spark, sf_dir, make):
    lines = lines_of_orders(spark, sf_dir)
    n = F.col("l_quantity").cast("int").cast("string")
    item = lines.withColumn("i", parse_line(make(F.col("p_name"), n)))
    return item.select("l_orderkey", "l_linenumber", "i.product_text", "i.quantity", "i.unit")


_BUILT = (
    "SELECT l_orderkey, l_linenumber, p_name AS product_text, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS quantity, "
    "{} AS unit FROM lineitem JOIN part ON l_partkey = p_partkey"
)


@_query(_BUILT.format("'kg'"))
def parse_leading(spark, sf_dir):
    return _parsed(spark, sf_dir, lambda name, n: F.concat_ws(" ", n, F.lit("kg"), name))


@_query(_BUILT.format("'piece'"))
def parse_multiplier(spark, sf_dir):
    return _parsed(spark, sf_dir, lambda name, n: F.concat_ws(" ", name, F.lit("x"), n))


@_query(_BUILT.format("'kg'"))
def parse_compound(spark, sf_dir):
    return _parsed(spark, sf_dir, lambda name, n: F.concat_ws(" ", name, F.concat(n, F.lit("kg"))))


@_query(_BUILT.format("'bottle'"))
def parse_separated(spark, sf_dir):
    return _parsed(spark, sf_dir, lambda name, n: F.concat_ws(" ", name, n, F.lit("bottles")))


@_query(_BUILT.format("CAST(NULL AS VARCHAR)"))
def parse_bare(spark, sf_dir):
    return _parsed(spark, sf_dir, lambda name, n: F.concat_ws(" ", name, n))


@_query(
    "WITH first AS (SELECT p_name, CAST(min(p_partkey) AS VARCHAR) AS sku FROM part GROUP BY p_name) "
    "SELECT l_orderkey, l_linenumber, p_name AS product_text, CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) AS quantity, 'kg' AS unit, "
    "sku AS product_id, CAST(1.0 AS DOUBLE) AS confidence, 'confirmed' AS status "
    "FROM lineitem JOIN part ON l_partkey = p_partkey JOIN first USING (p_name)"
)
def match_exact_canonical(spark, sf_dir):
    return match_exact_lines(spark, sf_dir)


@_query()
def top5_candidates(spark, sf_dir):
    """The five best products for every distinct query of list_items."""
    items = _table(spark, sf_dir, "list_items").select("product_text", "unit", "ocr_confidence")
    return match_items(items, listed_catalog(spark, sf_dir))


@_query()
def process_documents_json(spark, sf_dir):
    """JSON of every scanned list."""
    docs = _table(spark, sf_dir, "scan_docs")
    return to_json_documents(process_documents(docs, listed_catalog(spark, sf_dir), key="scan_id"), "scan_id")


@_query(
    "SELECT scan_id, NOT coalesce(regexp_matches(text, '[^ \\t\\n\\v\\f\\r]'), false) AS no_text FROM scan_docs"
)
def no_text_documents(spark, sf_dir):
    return _table(spark, sf_dir, "scan_docs").select("scan_id", (~text.has_content(F.col("text"))).alias("no_text"))


@_query(
    "WITH p AS (SELECT a.p_partkey, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) "
    "SELECT p_partkey, round(CASE WHEN a = b THEN 1.0::DOUBLE WHEN 1.0::DOUBLE - abs(length(a) - length(b))::DOUBLE / greatest(length(a), length(b)) < 0.2 "
    "THEN 1.0::DOUBLE - abs(length(a) - length(b))::DOUBLE / greatest(length(a), length(b)) "
    "ELSE 1.0::DOUBLE - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END, 10) AS similarity FROM p"
)
def char_similarity(spark, sf_dir):
    """Every part's name beside that of the part that follows it."""
    part = _table(spark, sf_dir, "part")
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("b"))
    pairs = part.select("p_partkey", F.col("p_name").alias("a")).join(after, "p_partkey")
    return pairs.select("p_partkey", F.round(similarity.char_similarity(F.col("a"), F.col("b")), 10).alias("similarity"))
