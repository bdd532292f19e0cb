"""Containers filled first-fit decreasing."""

import random

from linematch.llm.packing import first_fit_decreasing, pack, packed_documents, unused_space

KINDS = "container string, capacity_tokens int"


def by_hand(sizes, capacity):
    """First fit over a list, without a tree."""
    room, place = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        room += [capacity] * (at == len(room))
        room[at] -= sizes[i]
        place[i] = at
    return place


def test_tree_equals_list():
    rnd = random.Random(3)
    for n in (0, 1, 2, 7, 64, 300):
        sizes = [rnd.choice([0, 1, 5, rnd.randint(1, 50), 50]) for _ in range(n)]
        assert first_fit_decreasing(sizes, 50).tolist() == by_hand(sizes, 50)


def test_pack(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([0, 3, rnd.randint(1, 40), 250, 100])) for i in range(500)] + [(7, 5), (7, 5), (None, 9), (8, None)]
    items = spark.createDataFrame(rows, "doc_id long, tokens int")
    kinds = spark.createDataFrame([("a", 100), ("b", 1000), ("none", 0), ("null", None)], KINDS)
    for group_items in (50, 10_000):
        packed = pack(items, kinds, group_items=group_items).collect()
        for name, capacity in (("a", 100), ("b", 1000)):
            mine = [r for r in packed if r.container == name]
            assert sum(r.piece_tokens for r in mine) == sum(t or 0 for _, t in rows)
            fill = {}
            for r in mine:
                fill[r.container_no] = fill.get(r.container_no, 0) + r.piece_tokens
            assert all(fill[r.container_no] == r.fill_tokens <= capacity for r in mine)
            assert len([r for r in mine if r.piece > 1]) == (sum(-(-t // 100) - 1 for _, t in rows if t and t > 100) if capacity == 100 else 0)
            assert len([r for r in mine if r.doc_id == 7]) == 3 and len([r for r in mine if r.doc_id is None]) == 1
        assert {r.container for r in packed} == {"a", "b"}
    assert pack(items.limit(0), kinds).count() == 0 and pack(items, kinds.limit(0)).count() == 0


def test_documents(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "", "x"), (3, None, "x"), (4, "word " * 5000, "x"), (5, "ચોખા " * 100, "x")], "doc_id long, text string, container string")
    packed = packed_documents(docs, spark.createDataFrame([("small", 512)], KINDS))
    rows = packed.collect()
    assert {r.doc_id for r in rows} == {1, 2, 4, 5} and len([r for r in rows if r.doc_id == 4]) > 5
    (row,) = unused_space(packed).collect()
    assert row.containers >= row.least and 0 <= row.unused < 0.5
