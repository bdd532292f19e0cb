"""Properties that hold for any input."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from linematch.functions import csv_index
from linematch.functions.edit_distance import Patterns, plain_distance
from linematch.functions.parser import LineParser
from linematch.functions.segments import automaton, values_of
from linematch.operators.scoring import Block, Product, best_columns, total_score

WORD = st.text("abcર🍚", min_size=1, max_size=6)
NORMAL = st.lists(WORD, max_size=4).map(" ".join)
LISTS = st.lists(NORMAL, max_size=3)
PRODUCTS = st.lists(st.tuples(NORMAL, LISTS, LISTS, st.sampled_from(["", "abc", "ab c"]), st.lists(st.sampled_from(["kg", "g"]), max_size=2)), min_size=1, max_size=6)


def made(rows):
    return Block([Product(i, f"s{i}", n, n, a, e, b, b, u) for i, (n, a, e, b, u) in enumerate(rows)])


@settings(max_examples=150, deadline=None)
@given(PRODUCTS, st.lists(NORMAL, min_size=1, max_size=5))
def test_scores_stay_in_their_bounds(rows, queries):
    block = made(rows)
    c = block.components(queries)
    unit = np.zeros((len(queries), len(rows)))
    score = total_score(c, np.full((len(queries), 1), 0.7), unit)
    for i, q in enumerate(queries):
        for j, (name, aliases, *_) in enumerate(rows):
            exact = q == name or q in aliases
            assert bool(c["exact"][i, j]) == exact and 0.07 - 1e-12 <= score[i, j] <= 1.0
            if q:
                assert score[i, j] >= 0.97 - 1e-12 if exact else score[i, j] <= 0.85 + 1e-12
    assert all(((0 <= x) & (x <= 1)).all() for x in c.values())


@settings(max_examples=150, deadline=None)
@given(st.lists(NORMAL, min_size=1, max_size=8, unique=True))
def test_hybrid_is_one_only_for_equal_texts(texts):
    hybrid, _, equal = made([(t, [], [], "", []) for t in texts]).similarities(texts)
    assert ((hybrid == 1.0) == equal).all() and equal.sum() == len(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcé", max_size=80), min_size=1, max_size=6), st.lists(st.text("abcdé", max_size=80), min_size=1, max_size=6))
def test_edit_distance(keys, texts):
    patterns = Patterns(keys)
    codes, sizes = patterns.coded(texts)
    node, row = (x.ravel() for x in np.meshgrid(np.arange(len(keys)), np.arange(len(texts))))
    got = patterns.distances(node, codes, sizes, row, texts)
    assert got.tolist() == [plain_distance(keys[n], texts[r]) for n, r in zip(node, row, strict=True)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), min_size=5, max_size=5), min_size=1, max_size=5), st.integers(1, 7))
def test_best_columns_are_those_of_a_sort(scores, k):
    row, column = best_columns(np.array(scores, float), k)
    want = [(i, j) for i, s in enumerate(scores) for j in sorted(range(5), key=lambda j: (-s[j], j))[:k]]
    assert list(zip(row.tolist(), column.tolist(), strict=True)) == want


@settings(max_examples=400, deadline=None)
@given(st.text("12590.,xX-: \t\nkgપ૫્નીwali(", max_size=30))
def test_parser_invents_nothing(line):
    for strict in (True, False):
        item = LineParser(strict).parse(line)
        assert (item is None) == (not line.strip(" \t\n\x0b\f\r"))
        if item:
            text, quantity, unit, _ = item
            assert text == text.strip(" \t\n\x0b\f\r") and (quantity is None or quantity > 0) and (unit is None or quantity is not None)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.none() | st.text('a,"\n ક', max_size=20), max_size=8))
def test_fields_join_to_their_line(lines):
    fields = csv_index.index(pa.array(lines, pa.string()))
    got = fields.lists(fields.strings()).to_pylist()
    assert [None if f is None else ",".join(f) for f in got] == lines


@settings(max_examples=300, deadline=None)
@given(st.text('ab1,;|/" ', max_size=30))
def test_values_are_pieces_of_the_field(field):
    known = automaton(["a,b", "ab", "1/a"])
    for value in values_of(field, known):
        assert value and value == value.strip() and (value in field or value in field.replace('""', '"'))
