"""Uploads to text: validation, a provider interface and the deterministic mock provider."""

from __future__ import annotations

import os
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linematch.functions.text import has_content

MAX_UPLOAD_BYTES = 10 << 20
ENGINE_VARIABLE = "LINEMATCH_OCR_ENGINE"

#: Fixed values of the mock provider: file name parts, text, confidence, error; the first that applies counts.
DEFAULT_TEXT = "ચોખા ૫ કિલો\nદૂધ ૧ લિટર\nસાબુ ૪ નંગ\nRice 2 kg\nચા ૫૦૦ g"
NAME_RULES = [
    ("fail|error", "", 0.0, "SIMULATED_OCR_FAILURE"),
    ("empty|blank", "", 0.0, None),
    ("rice|english", "Rice 2 kg", 0.98, None),
    ("gujarati|chokha", "ચોખા ૫ કિલો", 0.98, None),
    ("mixed", "5 kg ચોખા", 0.98, None),
    ("hindi|chawal", "चावल 2 किलो", 0.98, None),
    ("unknown", "XYZUnknownThing 10 pcs", 0.90, None),
    ("missing_quantity", "ચોખા", 0.95, None),
    ("missing_unit", "ચોખા ૨", 0.95, None),
    ("gud|jaggery", "Gud 2 kg", 0.98, None),
    ("namak|salt", "Namak 1 kg", 0.98, None),
    ("kaju|cashew", "Kaju 250 g", 0.98, None),
    ("multiline", "ચોખા ૫ કિલો\nદૂધ ૧ લિટર\nસાબુ ૪ નંગ\nRice 2 kg", 0.95, None),
]
CONTENT_CONFIDENCE = 0.95
#: Names of the cloud provider, and the errors of an upload with their status.
CLOUD_NAMES = ("cloud_vision", "google_cloud_vision")
ERRORS = {
    "NO_IMAGE": (400, "No image file was uploaded."),
    "UNSUPPORTED_FORMAT": (400, "Uploaded file is not a supported image."),
    "EMPTY_IMAGE": (400, "Uploaded image file is empty."),
    "IMAGE_TOO_LARGE": (413, "Image exceeds maximum allowed size (10 MB)."),
    "OCR_FAILED": (502, "OCR failure: "),
    "NO_TEXT_DETECTED": (200, "No readable text was detected in the image."),
}

_RESULT = "struct<text:string,confidence:double,success:boolean,error:string>"


def _result(text: Column, confidence: float, error: str | None = None) -> Column:
    return F.struct(
        text.alias("text"),
        F.lit(confidence).alias("confidence"),
        ((text != "") & F.lit(error is None)).alias("success"),
        F.lit(error).cast("string").alias("error"),
    ).cast(_RESULT)


class OcrProvider(Protocol):
    name: str

    def extract(self, content: Column, path: Column, override: Column | None = None) -> Column:
        """STRUCT<text, confidence, success, error> of an upload."""


class MockOcr:
    """Text from the upload's own bytes or its file name; nothing leaves the executor."""

    name = "mock"

    def extract(self, content: Column, path: Column, override: Column | None = None) -> Column:
        """NULL or empty content is an error; rules look at the last part of path, NULL path has none; NULL override is none."""
        name = F.lower(F.coalesce(F.element_at(F.split(path, "/"), -1), F.lit("")))
        decoded = F.try_validate_utf8(content.cast("string"))
        strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
        readable = decoded.rlike("[^\\x00-\\x7F]") | F.lower(decoded).rlike("kg|rice|soap|g|liter")
        out = F.when(content.isNull() | (F.octet_length(content) == 0), _result(F.lit(""), 0.0, "EMPTY_IMAGE_BYTES"))
        if override is not None:
            out = out.when(override.isNotNull(), _result(strip(override), CONTENT_CONFIDENCE))
        out = out.when(F.coalesce(readable, F.lit(False)), _result(strip(decoded), CONTENT_CONFIDENCE))
        for pattern, text, confidence, error in NAME_RULES:
            out = out.when(name.rlike(pattern), _result(F.lit(text), confidence, error))
        return out.otherwise(_result(F.lit(DEFAULT_TEXT), CONTENT_CONFIDENCE))


class VisionOcr:
    """Place of a cloud provider; it has no implementation."""

    name = CLOUD_NAMES[1]

    def extract(self, content: Column, path: Column, override: Column | None = None) -> Column:
        raise NotImplementedError("no cloud OCR provider is part of this library")


def provider_of(engine: str | None = None) -> OcrProvider:
    """The provider named by engine or the environment; any unknown name is the mock."""
    name = (engine or os.environ.get(ENGINE_VARIABLE) or "mock").lower()
    return VisionOcr() if name in CLOUD_NAMES else MockOcr()


def scan_uploads(uploads: DataFrame, provider: OcrProvider | None = None) -> DataFrame:
    """Adds text, ocr_engine, ocr_confidence and error STRUCT<status, code, message> to uploads.

    uploads: path, content, content_type and, optionally, form_text and
    mock_ocr_text. A form text goes past OCR; NULL content without a path is a
    missing file.
    """
    provider = provider or MockOcr()
    form = F.col("form_text") if "form_text" in uploads.columns else F.lit(None).cast("string")
    override = F.col("mock_ocr_text") if "mock_ocr_text" in uploads.columns else None
    direct = F.coalesce(form != "", F.lit(False))
    kind, size = F.coalesce("content_type", F.lit("")), F.coalesce(F.octet_length("content"), F.lit(0))

    def error(code: str, more: Column | None = None) -> Column:
        status, message = ERRORS[code]
        text = F.lit(message) if more is None else F.concat(F.lit(message), more)
        return F.struct(F.lit(status).alias("status"), F.lit(code).alias("code"), text.alias("message"))

    ocr = uploads.withColumn("_o", F.when(~direct, provider.extract(F.col("content"), F.col("path"), override)))
    failed = (
        F.when(F.col("content").isNull() & F.col("path").isNull(), error("NO_IMAGE"))
        .when(~(kind.startswith("image/") | (kind == "application/octet-stream")), error("UNSUPPORTED_FORMAT"))
        .when(size == 0, error("EMPTY_IMAGE"))
        .when(size > MAX_UPLOAD_BYTES, error("IMAGE_TOO_LARGE"))
        .when(F.col("_o.error").isNotNull(), error("OCR_FAILED", F.col("_o.error")))
        .when(~has_content(F.col("_o.text")), error("NO_TEXT_DETECTED"))
    )
    return (
        ocr.withColumn("error", F.when(~direct, failed))
        .withColumn("text", F.when(direct, form).when(F.col("error").isNull(), F.col("_o.text")))
        .withColumn("ocr_engine", F.when(direct, "direct_text").otherwise(provider.name))
        .withColumn("ocr_confidence", F.when(~direct, F.col("_o.confidence")))
        .drop("_o")
    )


def read_uploads(spark: SparkSession, path: str, content_type: str = "image/jpeg") -> DataFrame:
    """Files of a folder as uploads (path, content, content_type)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content", F.lit(content_type).alias("content_type"))
