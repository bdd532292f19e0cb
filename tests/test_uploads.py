"""Uploads, providers, the service verbs and the command line."""

import json

import pytest

from linematch.plans.pipeline import Engine, process_uploads
from linematch.sources.ocr import MockOcr, VisionOcr, provider_of, read_uploads

PRODUCTS = [(1, "RICE001", "Rice", "", "Grains", ["ચોખા", "चावल"], [], ["kg"]), (2, "SOAP001", "Soap", "", "Household", ["સાબુ"], [], [])]
SCHEMA = (
    "catalog_pos int, sku string, canonical_name string, brand string, category string, "
    "aliases array<string>, ocr_errors array<string>, units array<string>"
)
JPEG = b"\xff\xd8\xff\xe0"


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(PRODUCTS, SCHEMA)


def test_uploads_to_items(spark, products):
    rows = [
        ("/error-reports/rice_test.jpg", JPEG, "image/jpeg", None, None),
        ("chokha_5kg.jpg", JPEG, "application/octet-stream", None, None),
        ("empty_scan.jpg", JPEG, "image/jpeg", None, None),
        ("fail_ocr.jpg", JPEG, "image/jpeg", None, None),
        ("test.txt", b"x", "text/plain", None, None),
        ("zero.jpg", b"", "image/jpeg", None, None),
        ("big.jpg", JPEG * ((10 << 18) + 1), "image/jpeg", None, None),
        (None, None, None, None, None),
        ("form.jpg", None, None, "Soap x 4", None),
        ("over.jpg", JPEG, "image/jpeg", None, " Rice 3 kg "),
        ("own.jpg", "ચોખા ૫ કિલો".encode(), "image/jpeg", None, None),
        ("other.jpg", JPEG, "image/jpeg", None, None),
    ]
    uploads = spark.createDataFrame(rows, "path string, content binary, content_type string, form_text string, mock_ocr_text string")
    got = {r.path: r for r in process_uploads(uploads, products).collect()}
    assert len(got) == len(rows)
    codes = {p: (r.success, r.status, r.error and r.error.code) for p, r in got.items()}
    assert codes == {
        "/error-reports/rice_test.jpg": (True, 200, None), "chokha_5kg.jpg": (True, 200, None), "form.jpg": (True, 200, None),
        "over.jpg": (True, 200, None), "own.jpg": (True, 200, None), "other.jpg": (True, 200, None),
        "empty_scan.jpg": (False, 200, "NO_TEXT_DETECTED"), "fail_ocr.jpg": (False, 502, "OCR_FAILED"),
        "test.txt": (False, 400, "UNSUPPORTED_FORMAT"), "zero.jpg": (False, 400, "EMPTY_IMAGE"),
        "big.jpg": (False, 413, "IMAGE_TOO_LARGE"), None: (False, 400, "NO_IMAGE"),
    }
    first = got["/error-reports/rice_test.jpg"]
    assert (first["items"][0].product_id, first["items"][0].quantity, first.ocr_engine, first.ocr_confidence) == ("RICE001", 2.0, "mock", 0.98)
    assert got["form.jpg"].ocr_engine == "direct_text" and got["form.jpg"]["items"][0].unit == "piece"
    assert len(got["other.jpg"]["items"]) == 5
    assert len({r.request_id for r in got.values()}) == len(rows) and first.request_id.startswith("REQ-")


def test_providers(monkeypatch):
    assert isinstance(provider_of("cloud_vision"), VisionOcr) and provider_of("GOOGLE_CLOUD_VISION").name == "google_cloud_vision"
    assert isinstance(provider_of("other"), MockOcr)
    monkeypatch.setenv("LINEMATCH_OCR_ENGINE", "cloud_vision")
    assert isinstance(provider_of(), VisionOcr)
    with pytest.raises(NotImplementedError):
        VisionOcr().extract(None, None)


def test_files_as_uploads(spark, products, tmp_path):
    (tmp_path / "rice.jpg").write_bytes(JPEG)
    (row,) = process_uploads(read_uploads(spark, str(tmp_path)), products).collect()
    assert row["items"][0].product_id == "RICE001"


def test_engine_and_command_line(spark, tmp_path, capsys):
    from linematch.cli import main
    from linematch.sources.catalog import CatalogError

    one, two = tmp_path / "a.csv", tmp_path / "b.csv"
    one.write_text("sku,canonical_name,category,aliases\nRICE001,Rice,Grains,ચોખા|चावल\n# x\n\nshort,line\n", encoding="utf-8")
    two.write_text("product_id,canonical_name,category,aliases\nSOAP001,Soap,Household,સાબુ\n", encoding="utf-8")
    with Engine(spark) as engine:
        assert engine.health()["catalog"] == "error"
        with pytest.raises(CatalogError):
            engine.process_text("Rice")
        assert engine.load_catalog(str(tmp_path / "*.csv")) == 2
        assert [r.sku for r in engine.products.orderBy("catalog_pos").collect()] == ["RICE001", "SOAP001"]
        result = engine.match("Rice 2 kg\nસાબુ ૪ નંગ")
        assert [i["product_id"] for i in result["items"]] == ["RICE001", "SOAP001"] and result["request_id"].startswith("REQ-")
        assert engine.health() | {"version": ""} == {
            "success": True, "ok": True, "version": "", "catalog": "loaded", "ocr_engine": "mock", "cloud_vision_configured": False,
        }
    text = tmp_path / "list.txt"
    text.write_text("Rice 2 kg", encoding="utf-8")
    assert main([str(text), str(one)], spark) == 0
    assert json.loads(capsys.readouterr().out)["items"][0]["product_id"] == "RICE001"
    assert main([], spark) == 2
    assert main(["Rice", str(tmp_path / "none.csv")], spark) == 4
    (tmp_path / "empty.csv").write_text("sku\n")
    assert main(["Rice", str(tmp_path / "empty.csv")], spark) == 4


def test_stream_equals_batch(spark, products, tmp_path):
    from linematch.plans.pipeline import match_parsed, parse_items, split_lines
    from linematch.streaming.match_stream import match_stream

    docs = spark.createDataFrame([(1, "Rice 2 kg\nSoap x 4"), (2, None), (3, "rcie\r\n\r\nother 3")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    match_stream(stream, products, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch_id")
    want = match_parsed(parse_items(split_lines(docs)), products).select(got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 4
