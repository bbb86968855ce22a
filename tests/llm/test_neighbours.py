"""Neighbours against brute force; copies, bad vectors, blocks."""

import numpy as np
import pytest

from quirelake.llm import neighbours as N


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in rows], "id string, embedding array<float>, vec string")


def clusters(n=1200, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, dim))
    return np.concatenate([base + rng.normal(scale=0.05, size=base.shape) for _ in range(3)]).astype(np.float32)


@pytest.mark.parametrize("block", [8192, 60])
def test_close_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(N, "PART_ROWS", 150)
    monkeypatch.setattr(N, "BLOCK_ROWS", block)
    x = clusters()
    ids = [f"v{i:04d}" for i in range(len(x))]
    bad = [("n", None), ("z", [0.0] * 16), ("s", [1.0] * 3), ("e", []), ("nan", [float("nan")] * 16), ("none", [None] + [1.0] * 15)]
    df = table(spark, [*zip(ids, x), *bad, (ids[0], x[0])])
    r = N.search(df, "id", "embedding", dim=16, k=5, floor=0.9)
    got = {tuple(sorted((p["id_a"], p["id_b"]))) for p in N.expand(r, "id").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(s >= 0.9)) if i < j}
    assert len(want & got) >= 0.97 * len(want) and not got - want
    assert {c["id"] for c in r.classes.collect()} == set(ids)


def test_recall_of_all_neighbours(spark, monkeypatch):
    monkeypatch.setattr(N, "PART_ROWS", 200)
    x = clusters(900)
    ids = [f"v{i:04d}" for i in range(len(x))]
    r = N.search(table(spark, zip(ids, x)), "id", "embedding", dim=16, k=5, recall=0.95)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    best = {ids[i]: {ids[j] for j in np.argsort(-s[i])[:5]} for i in range(len(ids))}
    got = {}
    for p in r.pairs.collect():
        got.setdefault(p["a"], set()).add(p["b"])
    assert np.mean([len(got.get(i, set()) & best[i]) / 5 for i in ids]) >= 0.9


def test_copies(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=16), rng.normal(size=16)
    rows = [(f"c{i:03d}", a * (i % 3 + 1)) for i in range(40)] + [("d", b), ("d", b)]
    r = N.search(table(spark, rows), "id", "embedding", dim=16, floor=0.9)
    assert {c["id"]: c["class_id"] for c in r.classes.collect()}["d"] == "d"
    pairs = {(p["id_a"], p["id_b"]) for p in N.expand(r, "id").collect()}
    near = {}
    for p, q in pairs:
        near.setdefault(p, set()).add(q)
    assert all(len(near[f"c{i:03d}"]) >= 5 for i in range(40)) and "d" not in near


def test_empty_and_single(spark):
    df = table(spark, [("a", [1.0] * 16)])
    assert N.search(df, "id", "embedding", dim=16).pairs.count() == 0
    assert N.search(df.limit(0), "id", "embedding", dim=16, floor=0.9).pairs.count() == 0


def test_probes_rest_on_neighbours_among_all_rows(spark):
    rng = np.random.default_rng(3)
    x = N.unit_rows(rng.normal(size=(6000, 16))).astype(np.float32)
    x[5000:5040] = N.unit_rows(x[:40] + 0.02 * rng.normal(size=(40, 16)))  # no close pair among the first 1,000
    df = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "id int, vec binary").repartition(7)
    at, near = N.true_neighbours(df, x[:1000], 5, 0.97)
    assert sorted(at) == list(range(40)) and all((near[i] == x[5000 + q]).all() for i, q in enumerate(at))
    at, near = N.true_neighbours(df, x[:50], 5)
    sim = np.sort(x[:50] @ x.T, axis=1)[:, -6:-1].min(axis=1)
    assert len(at) == 250 and (np.einsum("ij,ij->i", x[at], near) >= sim[at] - 1e-5).all()
