"""Goldens of FIXTURES.md: parser, text, similarity, scores, policy and whole documents."""

import json

import pytest
from pyspark.sql import functions as F

from linematch.functions import similarity, text
from linematch.functions.parser import LineParser, ParserOptions, parse_line
from linematch.operators.decision import reason_of, status_of
from linematch.plans.pipeline import Engine, process_documents, to_json_documents

LINES = {
    "2 kg rice": (2.0, "kg", "rice"), "Rice 5 kg": (5.0, "kg", "Rice"), "rice 2kg": (2.0, "kg", "rice"), "rice - 2 kg": (2.0, "kg", "rice"),
    "Soap x 4": (4.0, "piece", "Soap"), "Shampoo 2 bottles": (2.0, "bottle", "Shampoo"), "500 g badam": (500.0, "g", "badam"),
    "2 किलो rice": (2.0, "kg", "rice"), "2 કિલો ચોખા": (2.0, "kg", "ચોખા"), "ચોખા ૫ કિલો": (5.0, "kg", "ચોખા"), "ચોખા પ કિલો": (5.0, "kg", "ચોખા"),
    "ચોખા ૨૫ કિલોગ્રામ": (25.0, "kg", "ચોખા"), "ખાંડ ૫૦૦ ગ્રામ": (500.0, "g", "ખાંડ"), "દૂધ ૧ લિટર": (1.0, "liter", "દૂધ"), "સાબુ ૪ નંગ": (4.0, "piece", "સાબુ"),
    "ચા ૫૦૦ g": (500.0, "g", "ચા"), "ચોખા 1.5 કિલો": (1.5, "kg", "ચોખા"), "ચોખા 5 કિલો": (5.0, "kg", "ચોખા"), "ચોખા 5 કલો": (5.0, "kg", "ચોખા"),
    "ચોખા 5 કલા": (5.0, "kg", "ચોખા"), "દૂધ 2 લિટર": (2.0, "liter", "દૂધ"), "દૂધ 2 લટિર": (2.0, "liter", "દૂધ"), "દૂધ 2 લટર": (2.0, "liter", "દૂધ"),
    "દૂધ 2 લીટર": (2.0, "liter", "દૂધ"), "ચોખા": (None, None, "ચોખા"), "ચોખા ૨": (2.0, None, "ચોખા"), "XYZRandomGadget 3 pcs": (3.0, "piece", "XYZRandomGadget"),
    "10 રૂ. ની ધાણાદાળ": (10.0, "rupee", "ધાણાદાળ"), "સોપારી 10 સુંઘારી": (10.0, None, "સોપારી સુંઘારી"), "badam 500 tukda": (500.0, None, "badam tukda"),
    "rice 5 kg basmati": (5.0, "kg", "rice basmati"), "rice 5kg basmati": (None, None, "rice 5kg basmati"), "Lux 2": (2.0, "piece", "Lu"),
    "rice - 2kg": (2.0, "kg", "rice -"), "7up 2 bottles": (2.0, "bottle", "up"), "1,000 g rice": (1.0, "g", "rice"), "0 kg rice": (None, None, "0 kg rice"),
    "5 kg. rice": (5.0, None, "kg. rice"), "2 kg soap x 4": (4.0, "piece", "soap"), "Diwali": (None, None, "Di"), "5 kg": (5.0, "kg", ""),
    "1. Rice 2 kg": (2.0, "kg", "Rice"), "rice - :": (None, None, "rice -"), "rice 5.": (5.0, None, "rice"),
}


def test_lines(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "line string")
    got = {r.line: r.p for r in lines.select("line", parse_line(F.col("line")).alias("p")).collect()}
    assert {k: (p.quantity, p.unit, p.product_text) for k, p in got.items()} == LINES
    assert all((p.has_quantity, p.has_unit) == (p.quantity is not None, p.unit is not None) for p in got.values())


def test_looser_rules(spark):
    lines = spark.createDataFrame([(x,) for x in ("Lux 2", "Diwali", "પાપડ 2 kg", "Box 4", "Soap x 4", "tea wali")], "line string")
    got = {r.line: r.p for r in lines.select("line", parse_line(F.col("line"), ParserOptions(strict_parity=False)).alias("p")).collect()}
    assert {k: (p.quantity, p.unit, p.product_text) for k, p in got.items()} == {
        "Lux 2": (2.0, None, "Lux"), "Diwali": (None, None, "Diwali"), "પાપડ 2 kg": (2.0, "kg", "પાપડ"), "Box 4": (4.0, None, "Box"),
        "Soap x 4": (4.0, "piece", "Soap"), "tea wali": (None, None, "tea"),
    }


def test_long_lines_cost_no_more_than_their_length():
    parser = LineParser()
    for line in ("a " * 200_000, " x" * 200_000 + " 5", "5" * 200_000, "1 kg " * 100_000, "a" + " " * 300_000 + "b", "9 a " * 50_000):
        assert parser.parse(line) is not None


def test_text(spark):
    cases = {
        "  ચોખા,  ૫  કિલો! ": "ચોખા 5 કિલો", "1.5 KG": "1 5 kg", "ÉA": "Éa", "﻿a﻿b": "ab", "a\xa0b": "a b", "...": "", "": "", "क।ख": "क।ख",
    }
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    once = text.normalize_text(F.col("t"))
    got = {r.t: (r.n, r.again) for r in rows.select("t", once.alias("n"), text.normalize_text(once).alias("again")).collect()}
    assert got.pop(None) == ("", "")
    assert {k: n for k, (n, _) in got.items()} == cases and all(n == again for n, again in got.values())
    digits = spark.range(1).select(text.normalize_digits(F.lit("૨૫ ૫૦૦")).alias("d")).first().d
    assert digits == "25 500"
    languages = {"Rice ચોખા": "guj", "Rice चावल": "hin", "Rice": "eng", "123": "unknown", "चावल ચોખા": "guj"}
    rows = spark.createDataFrame([(k,) for k in languages], "t string").select("t", text.detect_language(F.col("t")).alias("l"))
    assert {r.t: r.l for r in rows.collect()} == languages


def test_similarity(spark):
    cases = [
        ("hybrid", "rice", "rice", 1.0), ("hybrid", "ચોખા", "ચોખા", 1.0), ("hybrid", "rice", "wheat", 0.0), ("char", "a", "zzzzzzzzzz", 0.1),
        ("char", "", "", 1.0), ("tok", "", "", 0.0), ("hybrid", "", "", 1.0), ("hybrid", "suqar", "sugar", 0.52),
        ("hybrid", "clinic plus", "clinic plus shampoo", 0.65 * 11 / 19 + 0.35), ("hybrid", "clinic plus shampoo", "clinic plus", 0.65 * 11 / 19 + 0.35 * 2 / 3),
        ("char", "ચોખા", "ચોખ", 0.75), ("char", "a", "abcde", 1.0 - 4 / 5), ("tok", "a a b", "a", 2 / 3), ("char", None, "a", 0.0),
    ]
    rows = spark.createDataFrame([(i, k, a, b) for i, (k, a, b, _) in enumerate(cases)], "i int, k string, a string, b string")
    value = (
        F.when(F.col("k") == "char", similarity.char_similarity(F.col("a"), F.col("b")))
        .when(F.col("k") == "tok", similarity.token_overlap(F.col("a"), F.col("b")))
        .otherwise(similarity.hybrid_similarity(F.col("a"), F.col("b")))
    )
    got = {r.i: r.v for r in rows.select("i", value.alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == pytest.approx([c[3] for c in cases])
    bands = spark.createDataFrame([(0.8,), (0.5,), (0.4999,), (None,)], "s double").select(similarity.confidence_band(F.col("s")).alias("b"))
    assert [r.b for r in bands.collect()] == ["HIGH", "MEDIUM", "LOW", "LOW"]


def test_policy(spark):
    cases = [
        (0.97, 0.97, "confirmed", "high_confidence_match"), (0.85, 0.80, "ambiguous", "multiple_close_candidates"), (0.85, 0.70, "confirmed", "high_confidence_match"),
        (0.58, 0.40, "suggested", "moderate_confidence"), (0.45, 0.20, "suggested", "low_confidence_suggestion"), (0.34, 0.0, "unidentified", "insufficient_confidence"),
        (0.36, None, "suggested", "low_confidence_suggestion"), (None, None, "unidentified", "insufficient_confidence"), (0.90, 0.89, "confirmed", "high_confidence_match"),
    ]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, *_) in enumerate(cases)], "i int, a double, b double")
    status = status_of(F.col("a"), F.col("b"))
    got = {r.i: (r.s, r.r) for r in rows.select("i", status.alias("s"), reason_of(status, F.col("a")).alias("r")).collect()}
    assert [got[i] for i in range(len(cases))] == [(s, r) for _, _, s, r in cases]


@pytest.fixture(scope="module")
def products(spark):
    rows = [
        (1, "RICE001", "Rice", "", "Grains", ["ચોખા", "चावल", "chawal"], [], ["kg", "g"]), (2, "MILK001", "Milk", "", "Dairy", ["દૂધ", "दूध"], [], ["liter"]),
        (3, "SOAP001", "Soap", "", "Household", ["સાબુ"], [], ["piece"]), (4, "LUX001", "Lux Soap", "Lux", "Household", [], [], ["piece"]),
        (5, "SUGR001", "Sugar", "", "Grains", ["ખાંડ", "चीनी"], ["suqar"], ["kg"]),
    ]
    return spark.createDataFrame(
        rows,
        "catalog_pos int, sku string, canonical_name string, brand string, category string, aliases array<string>, ocr_errors array<string>, units array<string>",
    )


def test_documents(spark, products):
    texts = {
        "english": "Rice 2 kg", "gujarati": "ચોખા ૫ કિલો", "mixed": "5 kg ચોખા", "hindi": "चावल 2 किलो", "unknown": "XYZRandomGadget 3 pcs",
        "no quantity": "ચોખા", "no unit": "ચોખા ૨", "null": None, "blank": " \r\n\t ", "bom": "﻿", "lines": "ચોખા ૫ કિલો\r\n\r\nદૂધ ૧ લિટર\nSoap x 4\n5 kg\n",
        "ocr": "suqar 1 kg", "dropped": "5 kg\n2 g",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r.doc_id: r for r in process_documents(docs, products).collect()}

    def first(name):
        i = got[name]["items"][0]
        return i.product_id, i.quantity, i.unit, round(i.confidence, 4), i.status

    assert first("english") == first("hindi") == ("RICE001", 2.0, "kg", 1.0, "confirmed")
    assert first("gujarati") == first("mixed") == ("RICE001", 5.0, "kg", 1.0, "confirmed")
    assert first("no quantity") == ("RICE001", None, None, 0.97, "confirmed") and first("no unit") == ("RICE001", 2.0, None, 0.97, "confirmed")
    assert first("unknown") == (None, 3.0, "piece", 0.0, "unidentified") and got["unknown"]["items"][0].candidates == []
    assert (got["ocr"]["items"][0].product_id, got["ocr"]["items"][0].status) == ("SUGR001", "suggested")
    assert [i.product_id for i in got["lines"]["items"]] == ["RICE001", "MILK001", "SOAP001"]
    assert (got["dropped"].success, got["dropped"]["items"]) == (True, [])
    assert {n: (got[n].success, got[n].error.code) for n in ("null", "blank")} == {n: (False, "NO_TEXT_DETECTED") for n in ("null", "blank")}
    assert got["bom"].success and got["gujarati"].language == "guj" and got["hindi"].language == "hin"


def test_json_shape(spark, products):
    with Engine(spark) as engine:
        engine.use(products)
        good = json.loads(engine.process_text('Rice "x" 2.34567 kg'))
        bad = json.loads(engine.process_text(" "))
    assert list(good) == ["success", "language", "items"] and list(bad) == ["success", "error", "items"]
    item = good["items"][0]
    assert list(item) == [
        "raw_text", "normalized_text", "product_text", "quantity", "has_quantity", "unit", "has_unit", "product_id", "name", "confidence",
        "status", "needs_confirmation", "reason", "candidates",
    ]
    assert item["quantity"] == 2.346 and item["raw_text"] == 'Rice "x" 2.34567 kg' and list(item["candidates"][0]) == ["product_id", "name", "score", "confidence"]
    assert bad == {"success": False, "error": {"code": "NO_TEXT_DETECTED", "message": "No readable text was detected in the OCR input."}, "items": []}
    docs = spark.createDataFrame([(1, "Rice\x07 2 kg")], "doc_id long, text string")
    assert json.loads(to_json_documents(process_documents(docs, products)).first().json)["items"][0]["raw_text"] == "Rice  2 kg"
