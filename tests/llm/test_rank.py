"""Median ranks against plain Python, on small groups and on groups cut into ranges."""

import random
import statistics

import pytest

from quirelake.llm import rank


def brute(rows, weights=None):
    groups = {}
    for g, i, *s in rows:
        if i is None:
            continue
        cur = groups.setdefault(g, {}).setdefault(i, [None] * len(s))
        for k, x in enumerate(s):
            if x is not None and x == x and (cur[k] is None or x > cur[k]):
                cur[k] = x
    out = {}
    for g, items in groups.items():
        ranks = {}
        for i, s in items.items():
            ranks[i] = [1 + sum(o[k] is not None and (x is None or o[k] > x) for o in items.values()) for k, x in enumerate(s)]
        order = sorted(items, key=lambda i: (all(x is None for x in items[i]), statistics.median(ranks[i]), round(sum(ranks[i]) / len(ranks[i]), 9), i))
        out |= {(g, i): (ranks[i], n + 1) for n, i in enumerate(order)}
    return out


def rows(n, groups, seed):
    rng = random.Random(seed)
    r = [(rng.choice(groups), f"i{rng.randint(0, n)}", *[rng.choice([None, float("nan"), rng.randint(0, 9) / 3, rng.random() * 1000]) for _ in range(4)]) for _ in range(n)]
    return r + r[:5] + [("a", None, 1.0, 1.0, 1.0, 1.0)]


@pytest.mark.parametrize("limit", [50_000, 20])
def test_against_brute(spark, monkeypatch, limit):
    monkeypatch.setattr(rank, "RANGE_ROWS", limit)
    data = rows(300, ["a", "a", "a", "b", None], 7)
    df = spark.createDataFrame([(*r, "x") for r in data], "g string, i string, s0 double, s1 double, s2 double, s3 double, median_rank string")
    got = {(r["g"], r["i"]): ([r[f"s{k}_rank"] for k in range(4)], r["position"]) for r in rank.median_rank(df, "g", "i", ["s0", "s1", "s2", "s3"]).collect()}
    assert got == brute(data)


def test_scale_does_not_matter(spark):
    df = spark.createDataFrame([("q", "a", 1.0, 9e9), ("q", "b", 3.0, 8e9), ("q", "c", 2.0, 1.0)], "g string, i string, s double, t double")
    first = [r["i"] for r in rank.median_rank(df, "g", "i", ["s", "t"]).orderBy("position").collect()]
    scaled = [r["i"] for r in rank.median_rank(df.selectExpr("g", "i", "s * 1e9 s", "ln(t) t"), "g", "i", ["s", "t"]).orderBy("position").collect()]
    assert first == scaled == ["b", "a", "c"]


def test_weights_and_empty(spark):
    df = spark.createDataFrame([("q", "a", 1.0, 2.0), ("q", "b", 2.0, 1.0)], "g string, i string, s double, t double")
    assert rank.median_rank(df, "g", "i", ["s", "t"], [0.9, 0.1]).where("position = 1").head()["i"] == "b"
    assert rank.median_rank(df.limit(0), "g", "i", ["s", "t"]).count() == 0
    with pytest.raises(ValueError):
        rank.median_rank(df, "g", "i", ["s"], [0.0])
