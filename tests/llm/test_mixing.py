"""Sources mixed to target shares."""

import random

import pytest
from pyspark.sql import functions as F

from linematch.llm.mixing import mixed, shares, thresholds

TARGETS = "source string, target_share double, max_repeats int"


def test_thresholds_come_within_half_a_row(spark):
    rnd = random.Random(5)
    rows = [(s, rnd.getrandbits(63) if s != "tied" else rnd.choice([5, 1 << 62]), rnd.choice([1, 7, 100, 3000])) for s in ("a", "b", "tied") for _ in range(400)]
    sizes = spark.createDataFrame(rows, "source string, hash long, tokens long")
    for share in (0.0, 0.001, 0.3, 0.77, 0.9999):
        parts = sizes.groupBy("source").agg(F.floor(F.sum("tokens") * share).alias("part"))
        limits = {r.source: r.limit for r in thresholds(sizes, parts).collect()}
        for source, part in parts.collect():
            mine = sorted((h, t) for s, h, t in rows if s == source)
            sums = [0]
            for i, (h, t) in enumerate(mine):
                if i and mine[i - 1][0] == h:
                    sums[-1] += t
                else:
                    sums.append(sums[-1] + t)
            taken = sum(t for h, t in mine if h < limits[source])
            assert abs(taken - part) == min(abs(s - part) for s in sums)


def test_mix(spark):
    rnd = random.Random(6)
    rows = [(i, "word " * rnd.randint(1, 60), s) for i, s in enumerate(["big"] * 600 + ["small"] * 60 + ["tiny"] * 30 + ["extra"] * 9)]
    rows += [(900, None, "big"), (901, "", "big"), (902, "a b", None), (None, "c d", "big"), (5, rows[5][1], "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens_", F.lit(1))
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.2, 3), ("tiny", 0.1, 4), ("absent", 0.1, 2), ("never", 0.0, 1)], TARGETS)
    mix = mixed(docs, targets)
    got = mix.collect()
    assert {r.source for r in got} == {"big", "small", "tiny"}
    caps = {"big": 1, "small": 3, "tiny": 4}
    assert all(1 <= r.repeats <= caps[r.source] for r in got)
    for r in shares(mix, targets).collect():
        if r.source in caps:
            assert r.actual_share == pytest.approx(r.target_share / 0.9, abs=0.01)
        else:
            assert (r.documents, r.actual_share) == (0, 0.0)
    smaller = mixed(docs, targets, budget=500).collect()
    kept = {(r.doc_id, r.source): r.repeats for r in got}
    assert all(kept.get((r.doc_id, r.source), 0) >= r.repeats for r in smaller)
    assert mixed(docs.limit(0), targets).count() == 0 and mixed(docs, targets.limit(0)).count() == 0
