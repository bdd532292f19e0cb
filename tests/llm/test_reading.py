"""Reading bands."""

import random

from pyspark.sql import functions as F

from linematch.llm.reading import cleaned_ratings, has_words, prepared, reading_bands

WORDS = {
    "basic": "dogs find red apples at home today boys wash old carts",
    "middle": "customers record monthly prices because managers explain missing deliveries during week",
    "advanced": "committees harmonise provisional hierarchies insofar evaluators corroborate contradictory methodological assumptions",
}
LENGTH = {"basic": 4, "middle": 9, "advanced": 20}
DOCS = "doc_id long, text string"


def made(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        band = rnd.choice(list(WORDS))
        parts = []
        for _ in range(rnd.randint(3, 8)):
            b = band if rnd.random() < 0.9 else rnd.choice(list(WORDS))
            parts.append(" ".join(rnd.choices(WORDS[b].split(), k=LENGTH[b])) + f" Zu{rnd.randint(0, 999)}")
        rows.append((i, rnd.choice([". ", "\n", " ", ", "]).join(parts), band))
    return rows


def test_ratings(spark):
    rows = [(1, "r", "basic"), (1, "r", " BASIC"), (1, "s", "middle"), (2, "r", None), (3, "r", "hard"), (None, "r", "basic"), (1, "t", "basic")]
    got = {(r.doc_id, r.band): r.votes for r in cleaned_ratings(spark.createDataFrame(rows, "doc_id long, rater string, band string")).collect()}
    assert got == {(1, "basic"): 2, (1, "middle"): 1}


def test_held_out_accuracy(spark):
    rows = made(400, 7)
    docs = spark.createDataFrame([r[:2] for r in rows], DOCS)
    labels = spark.createDataFrame([(i, "r", b) for i, _, b in rows[:150]], "doc_id long, rater string, band string")
    got = {r.doc_id: r.band for r in reading_bands(docs, labels).collect()}
    held = [(i, b) for i, t, b in rows[150:] if i in got]
    assert sum(got[i] == b for i, b in held) >= 0.95 * len(held)


def test_rows(spark):
    rows = [(1, " a b c\nd e f g h "), (2, "a b c d e f g"), (3, None), (4, ""), (1, " a b c\nd e f g h "), (None, "x " * 9), (5, "a " * 200_000)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("coverage", F.lit(1))
    labels = spark.createDataFrame([], "doc_id long, rater string, band string")
    got = sorted(map(tuple, reading_bands(docs, labels).collect()), key=repr)
    assert got == sorted([(1, "middle"), (None, "middle"), (5, "middle")], key=repr)
    assert reading_bands(docs.limit(0), labels).count() == 0
    assert [r.w for r in docs.orderBy("doc_id").select(has_words(F.col("text")).alias("w")).collect()] == [True, True, True, False, False, False, True]
    assert prepared(docs).filter("size(words) < 8").count() == 0
