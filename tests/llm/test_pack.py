"""Containers: capacity, completeness, little room unused."""

import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from quirelake.llm.pack import allotments, fullest, lower_bound, numbered, pack, solve


def test_fullest_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(0, 8))]
        room = rng.randint(1, 60)
        best = max(sum(c) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n) if sum(c) <= room)
        got = fullest(dict(Counter(sizes)), room)
        assert sum(n * k for n, k in got) == best and all(k <= Counter(sizes)[n] for n, k in got)


def test_solution_uses_all():
    rng = random.Random(5)
    counts = Counter(min(100, int(rng.paretovariate(1.2) * 4)) for _ in range(5000))
    used = Counter()
    bins = 0
    for fill, times in solve(dict(counts), 100):
        assert sum(n * k for n, k in fill) <= 100
        bins += times
        for n, k in fill:
            used[n] += k * times
    assert used == counts and bins <= lower_bound(counts, 100) * 1.02 + 1
    runs = allotments(dict(counts), 100)
    assert all(sorted(g["first"])[0] == 0 and g["last"].max() + 1 == counts[n] for n, g in runs.groupby("size"))


def test_table(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([0, 3, 7, 7, 7, 50, 99, 100, 101, 250, None]), "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int, container string")
    got = pack(df, capacity=100).collect()
    pieces = {}
    room = Counter()
    for r in got:
        pieces.setdefault(r["doc_id"], []).append((r["piece_no"], r["start_at"], r["size"]))
        room[r["container"]] += r["size"]
    assert max(room.values()) <= 100 and set(pieces) == {r[0] for r in rows}
    for i, n, _ in rows:
        p = sorted(pieces[i])
        assert sum(x[2] for x in p) == (n or 0) and [x[1] for x in p] == [100 * k for k in range(len(p))] and (len(p) == 1 or n > 100)
    total = sum(n or 0 for _, n, _ in rows)
    assert len(room) <= -(-total // 100) * 1.05 + 1
    assert pack(df.limit(0), capacity=100).count() == 0 and pack(df.where("n_tokens = 0"), capacity=100).select("container").distinct().count() == 1


def test_hot_key_is_numbered_in_parts(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5).cast("int").alias("size"))
    got = numbered(df, "size", ["id"], target=50).collect()
    by = {}
    for r in got:
        by.setdefault(r["size"], []).append(r["nth"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and sum(map(len, by.values())) == 2000
