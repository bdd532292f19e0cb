"""The matcher from text to decision."""

import json

import pytest
from pyspark.sql import functions as F

from linematch.operators.matcher import match_items
from linematch.plans.pipeline import Engine

SCHEMA = (
    "catalog_pos int, sku string, canonical_name string, brand string, category string, "
    "aliases array<string>, ocr_errors array<string>, units array<string>"
)
ITEMS = "product_text string, unit string, ocr_confidence double"


@pytest.fixture
def products(spark):
    return spark.createDataFrame(
        [
            (1, "RICE001", "Rice", "", "Grains", ["ચોખા", "चावल"], [], ["kg", "g"]),
            (2, "SOAP001", "Soap", "", "Household", ["સાબુ"], ["s0ap"], ["piece"]),
            (3, "CLIN001", "Clinic Plus Shampoo", "Clinic Plus", "Household", [], [], ["bottle"]),
        ],
        SCHEMA,
    )


def best(spark, products, text, unit=None, ocr=None):
    rows = match_items(spark.createDataFrame([(text, unit, ocr)], ITEMS), products).collect()
    return sorted((-r.score, r.catalog_pos, r.sku) for r in rows)


def test_matcher_goldens(spark, products):
    rows = best(spark, products, "ચોખા", ocr=0.95)
    assert len(rows) == 3 and rows[0][2] == "RICE001" and -rows[0][0] == pytest.approx(0.995)
    assert best(spark, products, "clinic plus shampoo")[0][2] == "CLIN001"


def test_document_end_to_end(spark, products):
    engine = Engine(spark)
    engine.use(products)
    got = json.loads(engine.process_text("Rice 2 kg\nXYZRandomGadget 3 pcs"))
    rice, other = got["items"]
    assert (rice["product_id"], rice["quantity"], rice["unit"], rice["confidence"], rice["status"]) == (
        "RICE001", 2.0, "kg", 1.0, "confirmed",
    )
    assert (other["product_id"], other["status"], other["candidates"]) == (None, "unidentified", [])


def test_null_lists_keep_the_name(spark):
    bare = spark.createDataFrame([(1, "T1", "Tea", None, None, None, None, None), (2, "S1", "Salt", None, None, ["mithu"], None, None)], SCHEMA)
    assert best(spark, bare, "tea")[0][2] == "T1"
    assert best(spark, bare, "mithu")[0][2] == "S1"


def test_null_and_repeated_keys(spark, products):
    from linematch.plans.pipeline import process_documents

    texts = [(None, "Rice 2 kg"), (None, "Soap x 4\nRice"), (7, "Rice"), (7, "Soap\nSoap"), (7, "Rice"), (8, None), (None, " ")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = process_documents(docs, products).collect()
    got = sorted((str(r.doc_id), r.success, [i.product_id for i in r["items"]]) for r in rows)
    assert got == [
        ("7", True, ["RICE001"]), ("7", True, ["RICE001"]), ("7", True, ["SOAP001", "SOAP001"]),
        ("8", False, []), ("None", False, []), ("None", True, ["RICE001"]), ("None", True, ["SOAP001", "RICE001"]),
    ]


def test_one_block_equals_many(spark, products):
    items = spark.createDataFrame([(t, u, o) for t in ("rice", "lux soap", "clinic", "", "ચોખા", "s0ap") for u in ("kg", None) for o in (None, 0.9)], ITEMS)
    one = match_items(items, products, k=2).collect()
    many = match_items(items, products, k=2, max_broadcast_bytes=400).collect()
    assert len(one) == 6 * 2 * 2 * 2 and sorted(map(repr, one)) == sorted(map(repr, many))


def test_scores_against_columns(spark, products):
    """The matrices against the similarity columns, for every pair."""
    from linematch.functions.similarity import hybrid_similarity, token_overlap
    from linematch.operators.scoring import Block, Product

    texts = ["rice", "basmati rice rice", "s", "", "soap soap", "clinic plus", "ચોખા", "x" * 70, "y" * 400, "rice " * 20 + "z"]
    norm = [t.strip() for t in texts]
    block = Block([Product(i, str(i), t, t, [], [], "", "", []) for i, t in enumerate(norm)])
    hybrid, shared, _ = block.similarities(norm)
    pairs = spark.createDataFrame([(i, a, j, b) for i, a in enumerate(norm) for j, b in enumerate(norm)], "i int, a string, j int, b string")
    for r in pairs.select("*", hybrid_similarity(F.col("a"), F.col("b")).alias("h"), token_overlap(F.col("a"), F.col("b")).alias("t")).collect():
        at = block.number[r.b]
        assert (hybrid[r.i, at], shared[r.i, at]) == pytest.approx((r.h, r.t)), r


def test_empty_catalog_and_no_items(spark, products):
    items = spark.createDataFrame([("rice", None, None)], ITEMS)
    assert match_items(items, products.limit(0)).count() == 0
    assert match_items(items.limit(0), products).count() == 0


def test_embedding_has_no_weight(spark, products):
    items = spark.createDataFrame([("rcie", None, None)], ITEMS)
    plain = {r.sku: r.score for r in match_items(items, products).collect()}
    hooked = match_items(items, products, embedding=lambda q, name: F.length(name).cast("double")).collect()
    assert {r.sku: r.score for r in hooked} == plain and {r.embedding_score for r in hooked} == {4.0, 19.0}


def test_pruned_equals_full(spark):
    """The k best found with bounds are those of the full scoring."""
    import random

    from linematch.operators import matcher

    rnd = random.Random(9)
    words = ["rice", "red", "brown", "soap", "lux", "tea", "ચોખા", "लाल", "jar", "family"]
    name = lambda: " ".join(rnd.choices(words, k=rnd.randint(1, 4)))
    rows = [(i, f"S{i}", name(), rnd.choice(["", "Lux", "Tea Co"]), "", [name() for _ in range(rnd.randint(0, 3))], [name()], ["kg"]) for i in range(60)]
    many = spark.createDataFrame(rows, SCHEMA)
    typed = ["".join(rnd.choice([c, c, c, ""]) for c in name()) + rnd.choice(["", " kg", " zz"]) for _ in range(300)] + ["", "q" * 90]
    items = spark.createDataFrame([(t, rnd.choice(["kg", None]), rnd.choice([None, 0.9])) for t in typed], ITEMS)
    best = match_items(items, many, k=4)
    full = matcher._top(matcher.score_components(items, many), 4).select(best.columns)
    assert sorted(map(repr, best.collect())) == sorted(map(repr, full.collect()))
