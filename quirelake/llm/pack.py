"""Items of varying length into containers of fixed capacity by minimum bin slack.

Only lengths matter to the packing, and they are bounded by the capacity. The cluster counts the items of each length;
the packing is solved over that table (at most `capacity` lengths, however many items there are); the items then look
up their container by their number within their length. An item over the capacity is cut into full containers and a rest.

Solving: the longest remaining item opens a container; a bitset subset-sum dynamic program over the remaining lengths
(big integers as bitsets, counts split in powers of two) finds the fullest feasible filling, which is removed, and the
same filling is repeated while the counts allow it, so the number of programs depends on the lengths, not on the items.

Defined cases: items of size 0 or null size go to the first container (container 0; it exists where there is any item).
Equal sizes are numbered by id. Repeated ids are different items only if their rows are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

CAPACITY = 2048
SALT_ROWS = 50_000


def fullest(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, how many) of a filling of at most `room` that leaves the least slack; longer lengths preferred."""
    steps: list[tuple[int, int, int]] = []
    reach = [1]
    mask = (1 << (room + 1)) - 1
    full = 1 << room
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, block = min(counts[length], room // length), 1
        while left:
            take = min(block, left)
            steps.append((length, take, length * take))
            reach.append((reach[-1] | (reach[-1] << (length * take))) & mask)
            left -= take
            block *= 2
        if reach[-1] & full:
            break
    total = reach[-1].bit_length() - 1
    used: dict[int, int] = {}
    for k in range(len(steps) - 1, -1, -1):
        length, take, size = steps[k]
        if not reach[k] >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= size
    return sorted(used.items(), reverse=True)


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Fillings and how often each is used: [([(length, how many)], times)]."""
    counts = {n: c for n, c in counts.items() if c > 0 and 0 < n <= capacity}
    out = []
    while counts:
        top = max(counts)
        counts[top] -= 1
        fill = dict(fullest({n: c for n, c in counts.items() if c}, capacity - top))
        counts[top] += 1
        fill[top] = fill.get(top, 0) + 1
        times = min(counts[n] // k for n, k in fill.items())
        for n, k in fill.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
        out.append((sorted(fill.items(), reverse=True), times))
    return out


def allotments(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Runs of items of one length: items first..last (from 0) lie `each` to a container, from container `container` on."""
    rows, taken, container = [], {}, 0
    for fill, times in solve(counts, capacity):
        for n, k in fill:
            first = taken.get(n, 0)
            rows.append((n, first, first + k * times - 1, k, container))
            taken[n] = first + k * times
        container += times
    return pd.DataFrame(rows, columns=["size", "first", "last", "each", "container"])


def numbered(items: DataFrame, key: str, order: list[str], target: int = SALT_ROWS) -> DataFrame:
    """Adds `nth`: the number of each row within its key, from 0; a hot key is spread over salts by a hash of the row.

    The order within a salt is that of `order`; the salts of a key follow each other. Counts of (key, salt) are small:
    one row per `target` rows and at least one per key.
    """
    sizes = items.groupBy(key).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / target)).cast("int").alias("salts"))
    salted = items.join(sizes, key).withColumn("salt", F.pmod(F.xxhash64(*order), F.col("salts")).cast("int")).drop("salts")
    per = salted.groupBy(key, "salt").agg(F.count("*").alias("n"))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy(key).orderBy("salt")) - F.col("n")).drop("n")
    nth = F.row_number().over(Window.partitionBy(key, "salt").orderBy(*order)) - 1
    return salted.withColumn("nth", nth).join(before, [key, "salt"]).withColumn("nth", (F.col("nth") + F.col("before")).cast("bigint")).drop("before", "salt")


def pack(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece_no, start_at, size, container) of every item; items within the capacity have the one piece 0.

    `sizes` is read twice; pass a cheap or durable frame.
    """
    n = F.coalesce(F.col(size_col), F.lit(0)).cast("bigint")
    full = F.when(n > capacity, F.floor((n - 1) / capacity)).otherwise(0).cast("bigint")
    pieces = sizes.select(id_col, n.alias("n"), full.alias("full")).select(id_col, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("full"))).alias("piece_no"))
    pieces = pieces.select(id_col, F.col("piece_no").cast("int").alias("piece_no"), (F.col("piece_no") * capacity).alias("start_at"), F.least(F.col("n") - F.col("piece_no") * capacity, F.lit(capacity)).cast("int").alias("size"))
    # Bounded: one row per length, at most capacity + 1.
    counts = {r["size"]: r["c"] for r in pieces.groupBy("size").agg(F.count("*").alias("c")).collect()}
    runs = allotments(counts, capacity)
    rest = pieces.where("size = 0").withColumn("container", F.lit(0).cast("bigint"))
    spark = sizes.sparkSession
    if runs.empty:
        return rest.select(id_col, "piece_no", "start_at", "size", "container")
    # Bounded by the fillings of `capacity` lengths: a few thousand rows; grouped by length, one array row per length.
    table = spark.createDataFrame(runs.astype("int64"), "size bigint, first bigint, last bigint, each bigint, container bigint")
    table = table.groupBy(F.col("size").cast("int").alias("size")).agg(F.array_sort(F.collect_list(F.struct("first", "last", "each", "container"))).alias("runs"))
    placed = numbered(pieces.where("size > 0"), "size", [id_col, "piece_no"]).join(F.broadcast(table), "size")
    run = F.filter("runs", lambda r: (r["first"] <= F.col("nth")) & (F.col("nth") <= r["last"]))[0]
    placed = placed.withColumn("run", run).withColumn("container", (F.col("run.container") + F.floor((F.col("nth") - F.col("run.first")) / F.col("run.each"))).cast("bigint"))
    cols = [id_col, "piece_no", "start_at", "size", "container"]
    return placed.select(*cols).unionByName(rest.select(*cols))


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Containers that any packing needs at least."""
    return math.ceil(sum(int(n) * int(c) for n, c in counts.items()) / capacity)


def waste(containers: np.ndarray, sizes: np.ndarray, capacity: int = CAPACITY) -> float:
    """Share of the containers' room that is unused."""
    return 1 - sizes.sum() / (len(np.unique(containers)) * capacity) if len(sizes) else 0.0
