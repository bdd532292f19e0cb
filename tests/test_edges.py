"""NULLs, empty and long texts, ties, repeated rows, empty tables and clashing columns in the general operators."""

import random

import pytest
from pyspark.sql import functions as F

from linematch.functions.amounts import amounts_to_convert, units_for_review
from linematch.functions.missing_units import UnitModel
from linematch.functions.segments import field_values, packed_values
from linematch.sources.feed import classified_lines, loaded_entries, rejected_lines

FEED = "feed_id string, line_no int, line string"
CATALOG = "canonical_name string, category string, aliases_en string, aliases_gu string, aliases_hi string, ocr_errors string, units string, pack_sizes string"


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_feed(spark):
    lines = spark.createDataFrame(
        [
            ("a", 1, "sku,canonical_name,category,aliases"), ("a", 2, None), ("a", 3, ""), ("a", 4, "AB123,Tea,C,x"), ("a", 4, "AB123,Tea,C,x"),
            ("a", 5, "AB123,Tea"), (None, 2, "AB123,Tea,C,x"), ("b", 2, "AB123,Tea,B,C,,,,,,"), ("c", 1, "sku,canonical_name,category,aliases"),
            ("a", 6, "AB123," + '"' + "x" * 200_000 + '"' + ",C,x"), ("a", 7, "AB123," + '""' * 100_000 + ",C,x"), ("a", None, "AB123,Tea,C,x"),
        ],
        FEED,
    ).withColumn("columns", F.lit("clash")).withColumn("reason", F.lit("clash"))
    assert rows_of(rejected_lines(lines)) == sorted([("a", 5, "column_count"), ("a", 7, "bad_name"), (None, 2, "column_count")], key=repr)
    assert sorted((r.feed_id, r.line_no) for r in loaded_entries(lines).collect()) == [("a", 4), ("a", 4), ("a", 6), ("b", 2)]
    assert classified_lines(lines.limit(0)).count() == 0


def test_values(spark):
    entries = spark.createDataFrame(
        [(1, "a;b", None, ""), (1, "a;b", None, ""), (None, "x|x", ",", " | "), (2, "1,5 kg;" + "v, " * 20_000, None, None)],
        "entry_id long, aliases string, ocr_errors string, units string",
    ).withColumn("pos", F.lit(9))
    got = packed_values(entries)
    assert got.filter("entry_id = 1").count() == 4 and got.filter("entry_id = 2").count() == 20_001
    assert rows_of(got.filter("entry_id IS NULL")) == [(None, "aliases", 1, "x"), (None, "aliases", 2, "x")]
    assert packed_values(entries.limit(0)).count() == 0
    catalog = spark.createDataFrame([("v, v", "C", None, None, None, None, "kg", None)], CATALOG)
    assert packed_values(entries, catalog).filter("entry_id = 2").count() == 10_001
    assert field_values(entries, ("units",), catalog.limit(0)).count() == 0


@pytest.fixture(scope="module")
def tables(spark):
    units = spark.createDataFrame([("g", "g", 1.0), ("kg", "g", 1000.0), ("dozen", "piece", 12.0), ("box", None, None)], "unit string, base_unit string, factor double")
    sources = spark.createDataFrame([("w", "g"), ("t", "dozen"), ("t", "dozen"), ("p", None)], "source_code string, default_unit string")
    entries = spark.createDataFrame([], "entry_id long, aliases string, ocr_errors string, units string")
    catalog = spark.createDataFrame([("Rice", "Grains", "chawal", None, None, None, None, None)], CATALOG)
    return units, sources, entries, catalog


def test_amounts(spark, tables):
    units, sources, entries, catalog = tables
    rows = [
        (1, "rice 5", "Rice", 5.0, None, "w"), (1, "rice 5", "Rice", 5.0, None, "w"), (2, "tea 2", "tea", 2.0, None, "t"), (3, "tea 2", "tea", 2.0, None, "p"),
        (4, None, None, 3.0, None, "w"), (5, None, None, None, None, None), (6, "x", "x", 2.0, "kg", "t"), (7, "x 2 box", "x", 2.0, "box", "w"),
        (8, "x 5 g", "x", 5.0, "g", "w"), (9, "x", "x", -1.0, None, "w"), (10, "x", "x", 0.2, None, "w"), (11, "y" * 100_000 + " 2 kg", "y", 2.0, "kg", "w"),
        (None, "z 1 kg", "z", 1.0, "kg", "w"),
    ]
    items = spark.createDataFrame(rows, "item_id long, raw_text string, product_text string, quantity double, unit string, source_code string")
    items = items.withColumn("default_unit", F.lit("clash")).withColumn("category", F.lit("clash"))
    got = [r[1:] for r in rows_of(amounts_to_convert(items, entries, sources, units, catalog))]
    want = [(1, 0, "g", 5), (1, 0, "g", 5), (2, 0, "piece", 24), (4, 0, "g", 3), (6, 0, "g", 2000), (11, 0, "g", 2000), (None, 0, "g", 1000)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r.item_id for r in units_for_review(items, sources, units, catalog).collect()} == {3}
    assert amounts_to_convert(items.limit(0), entries, sources, units, catalog.limit(0)).count() == 0


def test_unit_model_is_calibrated(spark):
    """Held-out rows: confident guesses are right, and a source never seen is not guessed with confidence."""
    rows = [("g" if i % 3 else "kg", float(i % 40 + 1) * (100 if i % 3 else 1), "s" if i % 2 else "u", "C", "eng", "stated") for i in range(3000)]
    rows += [("dozen", float(i % 9 + 1), "tray", "C", "eng", "missing") for i in range(1000)]
    schema = "label string, quantity double, source_code string, category string, lang string, stated string"
    random.Random(8).shuffle(rows)
    model = UnitModel(spark.createDataFrame(rows[::2], schema))
    new = [(u, q, "new", *more) for u, q, _, *more in rows[1::2]]
    for held, least in ((rows[1::2], 0.8), (new, 0.0)):
        got = model.predict(spark.createDataFrame(held, schema)).collect()
        sure = [r for r in got if r.confidence >= 0.9]
        assert len(sure) >= least * len(got) and sum(r.guess == r.label for r in sure) >= 0.9 * len(sure)
        assert all(r.guess == "dozen" and r.confidence >= 0.9 for r in got if r.source_code == "tray")
    nothing = UnitModel(spark.createDataFrame([], schema)).predict(spark.createDataFrame(rows[:2], schema)).collect()
    assert [(r.guess, r.confidence) for r in nothing] == [(None, 0.0)] * 2


def test_known_values_by_join(spark, monkeypatch):
    """However many values a catalog has, a field comes out the same; known values without marks count too."""
    known = ["a,b", "b,c", "c", "d;e;f", "f", "G/h", "Σας,İ", "x, y", '"q"|r', " p|"]
    texts = ["a,b,c", "c,a,b,c", "d;e;f;f", "[a,b,c]", '"a,b",c', "A,B;g/H", "σΑΣ,b,c", "İ,a,b", "x, y,x ,y", '"q"|r', "p", "c", "", ",", "a,b," * 5_000 + "c"]
    draw = random.Random(3)
    texts += ["".join(draw.choices("abcdef,,;/ ", k=draw.randint(1, 14))) for _ in range(400)]
    rows = [(n, t, None, texts[-n]) for n, t in enumerate(texts)] + [(0, "a,b,c", None, None)] * 3
    entries = spark.createDataFrame(rows, "entry_id long, aliases string, ocr_errors string, units string")
    catalog = spark.createDataFrame([(k, "C", "p|z" if k == "c" else None, None, None, None, None, None) for k in known], CATALOG)
    whole = rows_of(field_values(entries, products=catalog))
    assert [r[3] for r in whole if r[:2] == (0, "aliases")].count("a,b") == 4
    for held in (12, 5, 0):
        monkeypatch.setattr("linematch.functions.segments.DICTIONARY_VALUES", held)
        monkeypatch.setattr("linematch.functions.segments.SPAN_ROWS", 7, raising=False)
        assert rows_of(field_values(entries, products=catalog)) == whole
    assert field_values(entries.limit(0), products=catalog).count() == 0


def test_guesses_count_in_the_review_only(spark, tables, monkeypatch):
    """Amounts follow the source without any model; a confident guess against the source is for review."""
    units, sources, entries, catalog = tables
    made = []

    class Guesser:
        def __init__(self, labelled):
            made.append(labelled)

        def predict(self, rows):
            guess = F.when(F.col("source_code") == "w", "kg").otherwise("dozen")
            return rows.withColumns({"guess": guess, "confidence": F.when(F.col("quantity") > 4, 0.95).otherwise(0.5)})

    monkeypatch.setattr("linematch.functions.amounts.UnitModel", Guesser)
    rows = [
        (1, "rice 5", "Rice", 5.0, None, "w"), (2, "rice 3", "Rice", 3.0, None, "w"), (3, "eggs 5", "eggs", 5.0, None, "t"), (4, "tea 2", "tea", 2.0, None, "p"),
        (5, "tea 6", "tea", 6.0, None, "new"), (6, "tea 6", "tea", 6.0, None, None), (7, "rice 5 kg", "Rice", 5.0, None, "w"), (8, "tea", "tea", 1e35, "box", "w"), (9, "tea 1 kg", "tea", 1e35, None, "w"),
    ]
    items = spark.createDataFrame(rows, "item_id long, raw_text string, product_text string, quantity double, unit string, source_code string")
    got = [r[1:] for r in rows_of(amounts_to_convert(items, entries, sources, units, catalog))]
    assert got == [(1, 0, "g", 5), (2, 0, "g", 3), (3, 0, "piece", 60), (7, 0, "g", 5000), (9, 0, "g", 1000)]
    assert not made
    review = rows_of(units_for_review(items, sources, units, catalog))
    assert review == [(1, "kg", 0.95), (4, "dozen", 0.5), (5, "dozen", 0.95), (6, "dozen", 0.95)] and len(made) == 1
