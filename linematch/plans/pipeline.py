"""Documents to matched items: lines, parsed items, candidates, decision, nested result."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linematch.functions.parser import ParserOptions, parse_line
from linematch.functions.text import detect_language, has_content, lines_of, normalize_text
from linematch.operators.decision import decide
from linematch.operators.matcher import DEFAULT_OCR, match_items
from linematch.plans.lineage import checkpointed
from linematch.sources.catalog import CatalogError, read_catalog_csv
from linematch.sources.ocr import OcrProvider, provider_of, scan_uploads

VERSION = "0.2.0"

#: Fixed texts of the result.
NO_TEXT_CODE = "NO_TEXT_DETECTED"
NO_TEXT_MESSAGE = "No readable text was detected in the OCR input."

#: Control characters that JSON output shows as a blank.
_CONTROLS = "".join(chr(c) for c in range(0x20) if c not in (9, 10, 13))


def split_lines(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per non-blank line: keep, line_no (from 1), raw_text. NULL text gives no row."""
    lines = docs.select(*keep, F.posexplode(lines_of(F.col(text))).alias("line_no", "raw_text"))
    return lines.withColumn("line_no", F.col("line_no") + 1)


def parse_items(lines: DataFrame, options: ParserOptions = ParserOptions()) -> DataFrame:
    """Adds the parsed fields and normalized_text; lines without a product are dropped."""
    return (
        lines.withColumn("_item", parse_line(F.col("raw_text"), options))
        .filter(F.col("_item").isNotNull() & (F.col("_item.product_text") != ""))
        .withColumn("normalized_text", normalize_text(F.col("raw_text")))
        .select(*[c for c in lines.columns], "normalized_text", "_item.*")
    )


def match_parsed(items: DataFrame, products: DataFrame, **options: object) -> DataFrame:
    """items with the decision columns; every item of equal query, unit and confidence shares one scoring."""
    keys = ["q", "unit", "ocr"]
    decided = decide(match_items(items, products, **options), keys)
    decided = decided.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in decided.columns if c not in keys])
    ocr = F.col("ocr_confidence")
    left = items.withColumn("q", normalize_text(F.col("product_text"))).withColumn(
        "ocr", F.when(ocr > 0, ocr).otherwise(DEFAULT_OCR)
    )
    joined = left.join(
        decided,
        (F.col("q") == F.col("_q")) & F.col("unit").eqNullSafe(F.col("_unit")) & (F.col("ocr") == F.col("_ocr")),
        "left",
    )
    missing = F.col("status").isNull()
    return (
        joined.withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        .withColumn("needs_confirmation", F.coalesce("needs_confirmation", F.lit(True)))
        .withColumn("reason", F.coalesce("reason", F.lit("insufficient_confidence")))
        .withColumn("candidates", F.when(~missing, F.col("candidates")).otherwise(F.array().cast(decided.schema["candidates"].dataType)))
        .withColumn("status", F.coalesce("status", F.lit("unidentified")))
        .drop("_q", "_unit", "_ocr", "q", "ocr")
    )


def _shown(text: Column) -> Column:
    return F.translate(text, _CONTROLS, " " * len(_CONTROLS))


def item_struct() -> Column:
    """The item as the JSON sink shows it: rounded numbers, control characters as blanks."""
    return F.struct(
        _shown(F.col("raw_text")).alias("raw_text"),
        _shown(F.col("normalized_text")).alias("normalized_text"),
        _shown(F.col("product_text")).alias("product_text"),
        F.round("quantity", 3).alias("quantity"),
        "has_quantity",
        "unit",
        "has_unit",
        "product_id",
        "name",
        F.round("confidence", 4).alias("confidence"),
        "status",
        "needs_confirmation",
        "reason",
        F.transform("candidates", lambda c: c.withField("score", F.round(c["score"], 4))).alias("candidates"),
    )


def process_documents(docs: DataFrame, products: DataFrame, text: str = "text", key: str = "doc_id", **options: object) -> DataFrame:
    """One row per document: key, success, language, error, items (nested, in line order).

    Blank or NULL text gives success false with the error; a document whose
    lines hold no product gives success true and no items. Items depend on the
    text alone, so a digest of it is the row id: keys may be NULL or repeated,
    and equal texts are matched once.
    """
    docs = docs.select(key, text).withColumn("_doc", F.sha2(F.col(text), 256))
    lines = split_lines(docs.dropDuplicates(["_doc"]), text, ("_doc",))
    matched = match_parsed(parse_items(lines), products, **options)
    gathered = matched.groupBy("_doc").agg(
        F.array_sort(F.collect_list(F.struct("line_no", item_struct().alias("item")))).alias("_items")
    )
    ok = has_content(F.col(text))
    empty = F.array().cast(gathered.schema["_items"].dataType)
    return (
        docs.join(gathered, "_doc", "left")
        .select(
            key,
            ok.alias("success"),
            F.when(ok, detect_language(F.col(text))).alias("language"),
            F.when(~ok, F.struct(F.lit(NO_TEXT_CODE).alias("code"), F.lit(NO_TEXT_MESSAGE).alias("message"))).alias("error"),
            F.transform(F.coalesce("_items", empty), lambda x: x["item"]).alias("items"),
        )
    )


def to_json_documents(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and json; successful documents show language and items, others the error and no items."""
    keep = {"ignoreNullFields": "false"}
    good = F.to_json(F.struct("success", "language", "items"), keep)
    bad = F.to_json(F.struct("success", "error", "items"), keep)
    return results.select(key, F.when(F.col("success"), good).otherwise(bad).alias("json"))


def process_uploads(uploads: DataFrame, products: DataFrame, provider: OcrProvider | None = None, key: str = "path") -> DataFrame:
    """Uploads to OCR to matched documents, in one plan.

    key, request_id, success, language, error STRUCT<code, message>, status,
    items, ocr_engine, ocr_confidence: one row for each upload, whose error is
    that of the upload or else of its text. NULL keys and repeated rows stay.
    """
    scanned = scan_uploads(uploads, provider).withColumn("request_id", F.concat(F.lit("REQ-"), F.substring(F.replace(F.uuid(), F.lit("-")), 1, 12)))
    read = checkpointed(scanned.select(key, "request_id", "text", "error", "ocr_engine", "ocr_confidence"))  # request ids must not change
    matched = process_documents(read, products, key="request_id").withColumnRenamed("error", "text_error")
    failed = F.col("error").isNotNull()
    return read.join(matched, "request_id").select(
        key,
        "request_id",
        (F.col("success") & ~failed).alias("success"),
        "language",
        F.when(failed, F.struct(F.col("error.code").alias("code"), F.col("error.message").alias("message"))).otherwise(F.col("text_error")).alias("error"),
        F.coalesce("error.status", F.lit(200)).alias("status"),
        "items",
        "ocr_engine",
        "ocr_confidence",
    )


class Engine:
    """Catalog holder with the verbs load_catalog, process, process_text, process_source, match, health and close."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.products = spark, None

    def __enter__(self) -> "Engine":
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def load_catalog(self, path: str) -> int:
        """Replaces the catalog by the CSV file's products; their number. Raises CatalogError."""
        products = read_catalog_csv(self.spark, path).cache()
        n = products.count()
        self.use(products if n else None)
        if not n:
            raise CatalogError("CATALOG_EMPTY")
        return n

    def use(self, products: DataFrame | None) -> None:
        """Replaces the catalog by a DataFrame."""
        self.close()
        self.products = products

    def process(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        if self.products is None:
            raise CatalogError("CATALOG_EMPTY")
        return process_documents(docs, self.products, text, key)

    def process_text(self, text: str | None) -> str:
        """JSON of one text; the empty catalog is reported before the text is looked at."""
        docs = self.spark.createDataFrame([(0, text or "")], "doc_id long, text string")
        return to_json_documents(self.process(docs)).first()["json"]

    def process_source(self, path_or_text: str, parity_bytes: int | None = None) -> str:
        """JSON of a readable file's text, else of the argument itself.

        With parity_bytes (10 MB in the reference) a file of that size or more
        is not read, and its name is taken for the text.
        """
        import os

        if os.path.isfile(path_or_text) and (parity_bytes is None or os.path.getsize(path_or_text) < parity_bytes):
            with open(path_or_text, encoding="utf-8", errors="replace") as f:
                return self.process_text(f.read())
        return self.process_text(path_or_text)

    def match(self, text: str | None) -> dict:
        """The result of one text as the service gives it, with request_id and server_time_ms."""
        began = time.perf_counter()
        result = json.loads(self.process_text(text))
        return result | {"request_id": f"REQ-{uuid.uuid4().hex[:12]}", "server_time_ms": round((time.perf_counter() - began) * 1000, 2)}

    def health(self, provider: OcrProvider | None = None) -> dict:
        """Whether a catalog is loaded, the version and the OCR provider."""
        return {
            "success": True,
            "ok": True,
            "version": VERSION,
            "catalog": "loaded" if self.products is not None else "error",
            "ocr_engine": (provider or provider_of()).name,
            "cloud_vision_configured": False,
        }

    def close(self) -> None:
        if self.products is not None:
            self.products.unpersist()
        self.products = None
