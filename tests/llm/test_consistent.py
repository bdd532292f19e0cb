"""One consistent form of text."""

import random
import unicodedata

import pyarrow as pa
import pytest

from linematch.llm import codepoints as cp
from linematch.llm.consistent import consistent_strings, inconsistent_fields, with_consistent

CASES = {
    "Ｈａｌｍｅｒｕ": "Halmeru",
    "𝐎𝐬𝐭𝐫𝐞𝐥𝐚": "Ostrela",
    "Fylоmаr": "Fylomar",
    "laνin": "lavin",
    "Гречудo": "Гречудо",
    "аѕ": "as",
    "sаuno": "sauno",
    "अाम": "आम",
    "अखराेट": "अखरोट",
    "કાેબીજ": "કોબીજ",
    "घड़ी": "घड़ी",
    "झाडू़": "झाड़ू",
    "તાળંુ": "તાળું",
    "Pâté": "Pâté",
    "ệ": "ệ",
    "q̣̇": "q̣̇",
    "kobĳ": "kobij",
    "saﬀron": "saffron",
    "2.5㎏": "2.5kg",
    "５００": "500",
    "a b c　d": "a b c d",
    "Hal‍m​e﻿r­u": "Halmeru",
    "स्‍": "स्",
    "क्‍‍ष": "क्‍ष",
    "한": "한",
}
PLAIN = ["Pâté Végétal", "૫૦૦ ગ્રામ", "½ kg", "x²", "Борвинка", "СМЕТВАР", "Φουσκάλι", "घड़ी", "રક્‍ષા", "स्‌टील", "झा़ू", "प्या़", "", "a  b", "한"]


def formed(texts):
    text, changed = consistent_strings(pa.array(texts, pa.string()))
    return text.to_pylist(), changed.tolist()


def test_cases():
    assert formed(list(CASES)) == (list(CASES.values()), [True] * len(CASES))
    assert formed(PLAIN) == (PLAIN, [False] * len(PLAIN))
    assert formed([None, "a​", None]) == ([None, "a", None], [False, True, False])
    assert formed([]) == ([], [])


def test_idempotent_and_nfc():
    pool = [c for c in map(chr, [*range(0x20, 0x250), *range(0x300, 0x370), *range(0x1E00, 0x1F00)]) if unicodedata.name(c, "")]
    pool = [c for c in pool if not unicodedata.decomposition(c).startswith("<") and c not in "­͏ẛ" and unicodedata.category(c)[0] in "LM"]
    pool = [c for c in pool if "LATIN" in unicodedata.name(c) or "COMBINING" in unicodedata.name(c)]
    rnd = random.Random(1)
    texts = ["".join(rnd.choices(pool, k=rnd.randint(0, 12))) for _ in range(3000)]
    once, _ = formed(texts)
    assert once == [unicodedata.normalize("NFC", t) for t in texts]
    mixed = ["".join(rnd.choices([*pool, *CASES, *PLAIN, "‍", "̀"], k=6)) for _ in range(2000)]
    once, _ = formed(mixed)
    assert formed(once) == (once, [False] * len(once))


def test_batch_equals_alone():
    texts = [*CASES, *PLAIN, None, "x" * 100_000 + "​" + "о" * 50_000]
    assert formed(texts)[0] == [formed([t])[0][0] for t in texts]
    sliced = pa.array(["skip", *texts]).slice(1)
    assert consistent_strings(sliced)[0].to_pylist() == formed(texts)[0]


def test_round_trip():
    texts = ["", "a", "é", "क", "😀x", None, "\U0010ffff"]
    array = pa.array(texts)
    cps, offsets = cp.decode(array)
    import numpy as np

    assert cp.encode(cps, offsets, np.asarray(array.is_null())).to_pylist() == texts


def test_dataframe(spark):
    rows = [(1, "Ｈ", "a"), (1, "Ｈ", "a"), (2, None, None), (3, "", "a b"), (None, "ok", "е́")]
    items = spark.createDataFrame(rows, "item_id long, product_text string, raw_text string")
    got = sorted(map(tuple, inconsistent_fields(items).collect()), key=repr)
    assert got == sorted([(1, "product_text"), (1, "product_text"), (3, "raw_text"), (None, "raw_text")], key=repr)
    assert inconsistent_fields(items.limit(0)).count() == 0
    with pytest.raises(ValueError):
        with_consistent(items.withColumnRenamed("raw_text", "product_text_plain"), ["product_text"])
