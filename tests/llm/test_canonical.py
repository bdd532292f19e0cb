"""Typed values to entries of a reference list."""

import random

import numpy as np
import pytest

from linematch.functions.edit_distance import plain_distance
from linematch.llm.bktree import BKTree
from linematch.llm.canonical import consonants, inexact_values, resolve_values, words_of

CATALOG = "catalog_pos int, sku string, canonical_name string, aliases_en string, aliases_gu string, aliases_hi string, ocr_errors string"
ROWS = [
    (0, "RED01", "Halmeru Red Rice", "halmeru lal chawal", "Halmeru ચોખા Red", None, "halmeru rcd ricc"),
    (1, "RED02", "Wexadi Red Rice", None, None, None, None),
    (2, "BRN01", "Halmeru Brown Rice", None, None, None, None),
    (3, "SALT1", "Salt", "namak", "મીઠું", "नमक", None),
    (4, "FRSH1", "Clean Fresh Cream", None, None, None, None),
    (5, None, "No Sku", None, None, None, None),
    (6, "NULL1", None, None, None, None, None),
    (7, "LONG1", "x" * 80 + " jar", None, None, None, None),
]
TEXTS = {
    "halmeru red rice": "RED01",
    "hAlMeRu ReD rIcE": "RED01",
    "halmeru rde rice 5 kg": "RED01",
    "halmerured rice!!": "RED01",
    "Rice, Halmeru Red": "RED01",
    "hlmr rd rc": "RED01",
    "fresh halmeru red rice as usual": "RED01",
    "Ｈalmeru Rеd Ri​ce": "RED01",
    "halmeru rcd ricc": "RED01",
    "Halmeru ચોખા Red ૫ કિલો": "RED01",
    "wexadi red rise": "RED02",
    "halmeru brwn rice": "BRN01",
    "merudo red rice": "NONE",
    "halmeru raincoat": "NONE",
    "send with the boy": "NONE",
    "salt": "SALT1",
    "sal": "NONE",
    "નમક": "NONE",
    "नमक 1 किलो": "SALT1",
    "clean fresh cream": "FRSH1",
    "cream": "NONE",
    "no sku": "NONE",
    "": "NONE",
    " ... ": "NONE",
    "5 kg": "NONE",
    None: "NONE",
    "x" * 79 + " jar": "LONG1",
    "y " * 50_000: "NONE",
}


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(ROWS, CATALOG)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(0, "halmeru red rice")], "item_id long, product_text string")


def test_tree_finds_every_entry():
    rnd = random.Random(2)
    keys = sorted({"".join(rnd.choices("abcde", k=rnd.randint(0, 9))) for _ in range(400)} | {"a" * 70, "b" * 66})
    texts = ["".join(rnd.choices("abcdez", k=rnd.randint(0, 11))) for _ in range(100)] + ["a" * 69, "", "x" * 1000]
    limits = np.array([rnd.randint(0, 4) for _ in texts])
    found = sorted(zip(*(x.tolist() for x in BKTree(keys).within(texts, limits))))
    want = sorted((i, j, d) for i, t in enumerate(texts) for j, k in enumerate(keys) if (d := plain_distance(t, k)) <= limits[i])
    assert found == want
    assert [x.tolist() for x in BKTree([]).within(["a"], np.array([1]))] == [[], [], []]


def test_keys():
    assert words_of("8) Pâté 2 x 500 g, 1½ ડઝન 3pcs.") == ["pate"]
    assert consonants(["wexadi", "achar", "fish"]) == "wxdachrfsh"


def test_values(items, products):
    got = {r.item_id: r.sku for r in resolve_values(items, products).collect()}
    assert {t: got[i] for i, t in enumerate(TEXTS)} == TEXTS
    assert resolve_values(items, products).count() == len(TEXTS) + 1


def test_shards_agree(items, products):
    one = sorted(map(tuple, resolve_values(items, products).collect()))
    assert sorted(map(tuple, resolve_values(items, products, max_names=3).collect())) == one


def test_exact_rows_are_left_out(spark, items, products):
    more = items.unionByName(spark.createDataFrame([(90, "Halmeru Red Rice"), (91, "namak"), (92, "Namak")], items.schema))
    got = {r.item_id: r.sku for r in inexact_values(more.withColumn("sku", more.item_id), products).collect()}
    assert 90 not in got and 91 not in got and got[92] == "SALT1"
    assert got[list(TEXTS).index("halmeru rcd ricc")] == "RED01" and got[list(TEXTS).index(None)] == "NONE"


def test_empty_tables(items, products):
    assert {r.sku for r in resolve_values(items, products.limit(0)).collect()} == {"NONE"}
    assert resolve_values(items.limit(0), products).count() == 0
    assert resolve_values(items.limit(0), products, max_names=3).count() == 0
