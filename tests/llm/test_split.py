"""Pieces: size, order, overlap, completeness, natural ends."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from quirelake.llm.split import cut, split_oversized, split_texts


def check(text, limit, overlap):
    p = cut(text, limit, overlap)
    assert "".join(text[s + o : e] for s, e, o in p) == text
    assert all(e - s <= limit and 0 <= o <= overlap for s, e, o in p)
    assert p[0][2] == 0 and all(b[0] + b[2] == a[1] and b[0] >= a[0] for a, b in zip(p, p[1:]))
    assert len(p) == 1 if len(text) <= limit else len(p) > 1
    return p


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\n,;é\U0001f48a", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_random(text, limit, overlap):
    check(text, limit, overlap)


def test_cases():
    for text in ("", " ", "x" * 1200, "x" * 5000, " " * 4000, "a b " * 3000, "Ünder. " * 900, "one line\n" * 600):
        check(text, 1200, 120)
    with pytest.raises(ValueError):
        cut("x", 10, 10)


def test_natural_ends():
    rng = random.Random(1)
    text = " ".join(f"Sentence {i} has {'word ' * rng.randint(2, 14)}inside." for i in range(200))
    p = check(text, 1200, 120)
    assert all(text[e - 2 : e] == ". " for _, e, _ in p[:-1])
    assert all(text[s - 1] == " " for s, _, _ in p[1:])
    paragraphs = "\n\n".join("Short text here. " * 30 for _ in range(8))
    assert all(paragraphs[e - 2 : e] == "\n\n" for _, e, _ in cut(paragraphs)[:-1])


def test_table(spark):
    rows = [("f", "a", "x y " * 500, "k"), ("f", "a", "x y " * 500, "k"), ("f", "b", None, "k"), ("f", "c", "", "k"), ("g", "a", "short", "k")]
    df = spark.createDataFrame(rows, "field string, item_id string, text string, piece string")
    got = split_texts(df).collect()
    assert {(r["field"], r["item_id"]) for r in got} == {("f", "a"), ("f", "c"), ("g", "a")}
    assert sum(r["item_id"] == "a" and r["field"] == "f" for r in got) == [r["n_pieces"] for r in got if r["field"] == "f" and r["item_id"] == "a"][0]
    assert split_oversized(df).select("item_id").distinct().count() == 1 and split_texts(df.limit(0)).count() == 0
