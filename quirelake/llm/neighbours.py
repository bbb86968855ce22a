"""The most similar vectors for every vector, by learned partitions of a neighbour graph.

On a bounded sample the nearest-neighbour graph is built and partitioned evenly (balanced clusters, then rounds of moves
to the part where most graph neighbours lie, under a capacity); a small softmax classifier learns the part of a vector.
Every vector is indexed in its most probable part and asks in its `probes` most probable parts, where all pairs of
queries and members are compared in blocks of matrix products. The number of parts follows the number of vectors, so
the work per vector stays level up to MAX_PARTS * PART_ROWS vectors; beyond, parts grow and are compared in blocks.

Equal vectors are collapsed first: one representative (the smallest id) is indexed, the others are members of its class.

Recall is what the probes give: close neighbours (cosine 0.9 and more) share their probable parts, so few probes find
them; vectors that have only distant neighbours in a space without structure need many. `probes_for` measures, on a
held-out sample against brute force, the probes that a wanted recall takes.

Defined cases: null, empty, zero, non-finite vectors and vectors of another length than `dim` have no neighbours and are
nobody's; ids repeated with equal vectors count once, with differing vectors they stand in the class of each; ties of cosine go
to the smaller id; a vector has fewer than k neighbours where there are fewer vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quirelake.session import durable

FIT_ROWS, MOST_FIT_ROWS, PART_ROWS, MAX_PARTS = 24_576, 98_304, 2048, 8192
BLOCK_ROWS = 8192
GRAPH_K = 8
HELD_OUT, LEAST_PROBES = 8_192, 3
QUERIES = 1_000  # held-out rows whose neighbours among all rows set the probes
MEMBER, ASKS, BOTH = 0, 1, 2


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def knn_brute(q: np.ndarray, x: np.ndarray, k: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Indices and cosines of the k best rows of x for each row of q (rows of unit length), unordered."""
    ids, sims = [], []
    k = min(k, len(x))
    for lo in range(0, len(q), block):
        s = q[lo : lo + block] @ x.T
        at = np.argpartition(-s, k - 1, axis=1)[:, :k].copy()  # not a view: it would keep the whole block
        ids.append(at)
        sims.append(np.take_along_axis(s, at, axis=1))
    return np.concatenate(ids), np.concatenate(sims)


def _best_columns(scores, n: int, p: int, keep: int = 24, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The best columns of each row and their scores, best first; scores(lo, hi) gives a block of rows."""
    keep = min(keep, p)
    cols, vals = np.empty((n, keep), np.int32), np.empty((n, keep), np.float32)
    for lo in range(0, n, block):
        s = scores(lo, min(n, lo + block))
        at = np.argpartition(-s, keep - 1, axis=1)[:, :keep] if keep < p else np.tile(np.arange(p), (len(s), 1))
        v = np.take_along_axis(s, at, axis=1)
        o = np.argsort(-v, axis=1, kind="stable")
        cols[lo : lo + len(s)], vals[lo : lo + len(s)] = np.take_along_axis(at, o, axis=1), np.take_along_axis(v, o, axis=1)
    return cols, vals


def _balanced(scores, n: int, p: int, capacity: int) -> np.ndarray:
    """Each row to its best column with room; rows that are surest go first."""
    order, value = _best_columns(scores, n, p)
    part = np.full(n, -1, np.int64)
    room = np.full(p, capacity, np.int64)
    todo = np.arange(n)
    for level in range(order.shape[1]):
        if not len(todo):
            break
        want = order[todo, level]
        sure = np.argsort(-value[todo, level], kind="stable")
        want_s = want[sure]
        by = np.argsort(want_s, kind="stable")
        head = np.r_[True, want_s[by][1:] != want_s[by][:-1]]
        nth = np.empty(len(by), np.int64)
        nth[by] = np.arange(len(by)) - np.maximum.accumulate(np.where(head, np.arange(len(by)), 0))
        take = nth < room[want_s]
        got = sure[take]
        part[todo[got]] = want[got]
        room -= np.bincount(want[got], minlength=p)
        todo = todo[np.setdiff1d(np.arange(len(todo)), got)]
    for i in todo:
        j = int(np.argmax(room))
        part[i], room[j] = j, room[j] - 1
    return part


@dataclass
class Router:
    """Softmax classifier of parts: logits = x @ weights + bias."""

    weights: np.ndarray
    bias: np.ndarray

    def top(self, x: np.ndarray, m: int, block: int = 1024) -> np.ndarray:
        """The m most probable parts of each row, best first."""
        p = self.weights.shape[1]
        m = min(m, p)
        out = np.empty((len(x), m), np.int64)
        for lo in range(0, len(x), block):  # a block of rows against all parts is all that is held at once
            z = x[lo : lo + block] @ self.weights + self.bias
            at = np.argpartition(-z, m - 1, axis=1)[:, :m] if m < p else np.tile(np.arange(m), (len(z), 1))
            out[lo : lo + len(z)] = np.take_along_axis(at, np.argsort(-np.take_along_axis(z, at, axis=1), axis=1), axis=1)
        return out


    def places(self, x: np.ndarray, parts: np.ndarray, block: int = 256) -> np.ndarray:
        """For each row and each of its given parts, how many parts are more probable."""
        out = np.empty(parts.shape, np.int64)
        for lo in range(0, len(x), block):
            z = x[lo : lo + block] @ self.weights + self.bias
            own = np.take_along_axis(z, parts[lo : lo + block], axis=1)
            for k in range(parts.shape[1]):
                out[lo : lo + len(z), k] = (z > own[:, k : k + 1]).sum(axis=1)
        return out


def learn(x: np.ndarray, parts: int, seed: int = 11, epochs: int = 12) -> Router:
    """Fits the partitioning and its classifier on sample rows of unit length."""
    n, d = x.shape
    parts = max(1, min(parts, n))
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    if parts == 1:
        return Router(np.zeros((d, 1), np.float32), np.zeros(1, np.float32))
    capacity = int(np.ceil(1.05 * n / parts))
    graph, _ = knn_brute(x, x, GRAPH_K + 1)
    centres = x[rng.choice(n, parts, replace=False)]
    part = None
    for _ in range(6):  # balanced spherical clusters as the start
        part = _balanced(lambda lo, hi: x[lo:hi] @ centres.T, n, parts, capacity)  # noqa: B023
        sums = np.zeros((parts, d), np.float32)
        np.add.at(sums, part, x)
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    for _ in range(4):  # to the part of most graph neighbours, ties by the centre, under the capacity

        def votes(lo, hi, part=part, centres=centres):
            v = x[lo:hi] @ centres.T
            np.add.at(v, (np.repeat(np.arange(hi - lo), graph.shape[1]), part[graph[lo:hi]].ravel()), 1.0 / graph.shape[1])
            return v

        part = _balanced(votes, n, parts, capacity)
        sums = np.zeros((parts, d), np.float32)
        np.add.at(sums, part, x)
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    # The classifier learns the parts of a vector's graph neighbours with its own.
    target_of = part[graph]
    w, b = centres.T.copy() * 12, np.zeros(parts, np.float32)
    m1, m2, t = np.zeros_like(w), np.zeros_like(w), 0
    mb1, mb2 = np.zeros_like(b), np.zeros_like(b)
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, 2048):
            at = order[lo : lo + 2048]
            z = x[at] @ w + b
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            rows = np.arange(len(at))
            np.add.at(p, (rows, part[at]), -0.6)
            np.add.at(p, (np.repeat(rows, target_of.shape[1]), target_of[at].ravel()), -0.4 / target_of.shape[1])
            g, gb = x[at].T @ p / len(at), p.mean(axis=0)
            t += 1
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            mb1, mb2 = 0.9 * mb1 + 0.1 * gb, 0.99 * mb2 + 0.01 * gb * gb
            w -= 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-6)
            b -= 0.02 * (mb1 / (1 - 0.9**t)) / (np.sqrt(mb2 / (1 - 0.99**t)) + 1e-6)
    return Router(w.astype(np.float32), b.astype(np.float32))


def probes_for(router: Router, q: np.ndarray, at: np.ndarray, near: np.ndarray, recall: float, floor: float = -1.0) -> int:
    """Fewest probes at which true neighbours are reached with the recall: row i of `near` is one of row at[i] of the queries."""
    if not len(at):  # none of the queries has a neighbour
        return LEAST_PROBES
    need = router.places(q[at], router.top(near, 1))[:, 0]
    if floor > 0:  # a pair is found from either side
        need = np.minimum(need, router.places(near, router.top(q, 1)[at])[:, 0])
    need = np.sort(need)
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) + 1


def true_neighbours(vectors: DataFrame, q: np.ndarray, k: int = 5, floor: float = -1.0) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest other rows of (id, vec) of at least `floor` for each query, over all rows: (query numbers, vectors).

    Each task goes through its rows in blocks and keeps the k best of each query; at most len(q) * k rows come to the driver.
    """
    dim = q.shape[1]
    shared = vectors.sparkSession.sparkContext.broadcast(q)

    def run(batches):
        qs = shared.value
        sims, best = np.full((len(qs), k), -2, np.float32), np.zeros((len(qs), k, dim), np.float32)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for lo in range(0, len(qs) if len(x) else 0, 256):
                mine = slice(lo, min(lo + 256, len(qs)))
                at, new = knn_brute(qs[mine], x, k + 1)
                new = np.where((new >= floor) & ~(x[at] == qs[mine][:, None, :]).all(axis=2), new, -2).astype(np.float32)
                rows, cols = np.nonzero(new > sims[mine].min(axis=1, keepdims=True))
                for i in np.unique(rows):
                    j = cols[rows == i]
                    c = np.concatenate([sims[lo + i], new[i, j]])
                    v = np.concatenate([best[lo + i], x[at[i, j]]])
                    top = np.argsort(-c, kind="stable")[:k]
                    sims[lo + i], best[lo + i] = c[top], v[top]
        i, j = np.nonzero(sims > -2)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(sims[i, j]), pa.array([r.tobytes() for r in best[i, j]], pa.binary())], ["q", "sim", "vec"])

    found = vectors.select("vec").mapInArrow(run, "q int, sim float, vec binary")
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "vec")
    got = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("q", "vec").toArrow()
    return np.asarray(got.column("q")).astype(np.int64), _matrix(got.column("vec"), dim) if got.num_rows else np.zeros((0, dim), np.float32)


def clean(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, vec binary) of the valid vectors, of unit length in float32; repeated ids are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vecs = batch.column(0), batch.column(1)
            if not len(ids):
                continue
            flat = vecs.flatten()
            m = np.asarray(flat.cast(pa.float64()).fill_null(float("nan"))).reshape(-1, dim)
            norm = np.sqrt((m * m).sum(axis=1))
            ok = np.isfinite(norm) & (norm > 0)
            u = (m[ok] / norm[ok, None]).astype(np.float32) + np.float32(0)  # no negative zero
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok)), pa.array([r.tobytes() for r in u], pa.binary())], ["id", "vec"])

    return df.where((F.size(vec_col) == dim) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, vec binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a binary column as a float32 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float32).reshape(-1, dim) if len(column) else np.zeros((0, dim), np.float32)


@dataclass
class Result:
    classes: DataFrame  # id, class_id, shared: every valid id and the representative of its equal vectors
    pairs: DataFrame  # a, b, cosine: representatives and their neighbours, up to k per a


def classes_of(base: DataFrame) -> DataFrame:
    """(id, class_id, shared) of (id, vec): vectors meet by a digest; aggregated per digest before the join, so that a hot one is no hot task.

    shared tells whether the class has more than one id.
    """
    keyed = base.select("id", F.unhex(F.md5("vec")).alias("key"))
    per = keyed.groupBy("key").agg(F.min("id").alias("class_id"), (F.min("id") != F.max("id")).alias("shared"))
    return keyed.join(per, "key").select("id", "class_id", "shared").distinct()


def search(df: DataFrame, id_col: str, vec_col: str, dim: int = 64, k: int = 5, floor: float = -1.0, recall: float = 0.95, probes: int | None = None, fit_rows: int = FIT_ROWS) -> Result:
    """Up to k neighbours of cosine >= floor for every representative, and the classes of equal vectors.

    With a positive floor a pair counts from either side, so it is found if one of the two asks in the part of the other.
    """
    spark = df.sparkSession
    base = clean(df, id_col, vec_col, dim)
    id_type = dict(base.dtypes)["id"]
    reps = base.groupBy("vec").agg(F.min("id").alias("id"))
    # The fit sample: bounded, in order of a hash of the id; and the number of vectors, to set the number of parts.
    n = df.where(F.size(vec_col) == dim).count()
    fit_rows = max(fit_rows, min(MOST_FIT_ROWS, 12 * round(n / PART_ROWS)))  # twelve rows a part, within the bound
    share = min(1.0, 1.3 * (fit_rows + HELD_OUT) / max(n, 1))
    picked = df.where((F.size(vec_col) == dim) & F.col(id_col).isNotNull() & (F.pmod(F.xxhash64(id_col), 1_000_000) < int(share * 1_000_000)))
    rows = clean(picked, id_col, vec_col, dim).limit(2 * (fit_rows + HELD_OUT)).toArrow()
    x = _matrix(rows.column("vec"), dim).copy() if rows.num_rows else np.zeros((0, dim), np.float32)
    x = np.unique(x, axis=0)
    np.random.default_rng(5).shuffle(x)
    held = min(HELD_OUT, len(x) // 4)
    test, x = x[:held], x[held : held + fit_rows]
    parts = int(min(MAX_PARTS, max(1, round(n / PART_ROWS)), max(1, len(x) // 12)))
    router = learn(x, parts) if len(x) else Router(np.zeros((dim, 1), np.float32), np.zeros(1, np.float32))
    if probes is None:
        probes = max(LEAST_PROBES, probes_for(router, test[:QUERIES], *true_neighbours(reps, test[:QUERIES], k, floor), recall, floor)) if len(test) else 1
    probes = min(probes, router.weights.shape[1])
    # Blocks of a part, from its size in the sample: a group of one task stays bounded.
    size = np.bincount(router.top(x, 1)[:, 0], minlength=router.weights.shape[1]) * (max(n, 1) / max(len(x), 1)) if len(x) else np.ones(1)
    blocks = np.minimum(255, np.maximum(1, np.ceil(size / BLOCK_ROWS))).astype(np.int64)
    shared = spark.sparkContext.broadcast((router, blocks, probes))  # bounded: dim x MAX_PARTS

    def route(batches):
        r, blk, m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vecs = _matrix(batch.column(1), dim)
            top = r.top(vecs, m).astype(np.int64)
            h = np.arange(len(vecs), dtype=np.int64) + int.from_bytes(vecs[0].tobytes()[:3], "little")
            cell, role, row = [], [], []

            def send(p, on, mine, other, what, cell=cell, role=role, row=row):
                cell.append(p[on] * 65536 + (mine * 256 + other if what != ASKS else other * 256 + mine))
                role.append(np.full(len(on), what, np.int8))
                row.append(on)

            for i in range(m):
                p = top[:, i]
                b = blk[p]
                if i == 0:  # one copy is member and query where its part is one block
                    on = np.flatnonzero(b == 1)
                    send(p, on, 0, 0, BOTH)
                for other in range(int(b.max())):
                    on = np.flatnonzero((other < b) & (b > 1) if i == 0 else (other < b))
                    if i == 0:
                        send(p, on, h[on] % b[on], other, MEMBER)
                    send(p, on, h[on] % b[on], other, ASKS)
            take = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell)), pa.array(np.concatenate(role)), batch.column(0).take(take), batch.column(1).take(take)], ["cell", "role", "id", "vec"])

    routed = reps.select("id", "vec").mapInArrow(route, f"cell bigint, role tinyint, id {id_type}, vec binary")

    def compare(table: pa.Table) -> pa.Table:
        role = np.asarray(table.column("role").combine_chunks())
        vecs = _matrix(table.column("vec"), dim)
        ids = table.column("id").combine_chunks()
        mi, qi = np.flatnonzero(role != ASKS), np.flatnonzero(role != MEMBER)
        a, b, c = [], [], []
        if len(mi) and len(qi):
            mv = vecs[mi]
            names = np.asarray(ids.to_pandas(), object)
            want = min(k + 1, len(mi))  # one more: a vector meets itself in its own part
            for lo in range(0, len(qi), 1024):
                q = qi[lo : lo + 1024]
                s = vecs[q] @ mv.T
                if floor > 0:
                    i, j = np.nonzero(s >= floor - 1e-5)
                else:
                    j = np.argpartition(-s, want - 1, axis=1)[:, :want].ravel()
                    i = np.repeat(np.arange(len(q)), want)
                exact = np.einsum("ij,ij->i", vecs[q[i]].astype(np.float64), mv[j].astype(np.float64))
                ok = (exact >= floor) & (names[q[i]] != names[mi[j]])
                a.append(q[i[ok]])
                b.append(mi[j[ok]])
                c.append(exact[ok])
        at = np.concatenate(a) if a else np.zeros(0, np.int64)
        bt = np.concatenate(b) if b else np.zeros(0, np.int64)
        return pa.table({"a": ids.take(pa.array(at)), "b": ids.take(pa.array(bt)), "cosine": pa.array(np.concatenate(c) if c else np.zeros(0))})

    met = routed.groupBy("cell").applyInArrow(compare, f"a {id_type}, b {id_type}, cosine double")
    if floor > 0:  # found from either side
        met = met.select(F.explode(F.array(F.struct("a", "b", "cosine"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))).alias("x")).select("x.*")
    met = met.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    pairs = met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")
    return Result(classes_of(base), pairs)


def expand(result: Result, name: str, limit: int = 6) -> DataFrame:
    """(id_a, id_b, cosine) in both directions: neighbours of the classes' members and members of one class.

    For each class its `limit` smallest members stand for the class on the side of the neighbour, as they fill the
    places of the nearest; every member has its row on the other side. A class of copies is never joined with itself.
    """
    multi = durable(result.classes.where("shared").select("class_id", "id"))  # read three times below
    nth = F.row_number().over(Window.partitionBy("class_id").orderBy("id"))
    few = multi.withColumn("n", nth).where(F.col("n") <= limit).select("class_id", F.col("id").alias("near"))
    same = multi.join(few, "class_id").where("id <> near").select(F.col("id").alias("id_a"), F.col("near").alias("id_b"), F.lit(1.0).alias("cosine"))
    near = result.pairs.join(few, result.pairs["b"] == few["class_id"], "left").select("a", F.coalesce("near", "b").alias("id_b"), "cosine")
    members = multi.select("class_id", F.col("id").alias("own"))
    other = near.join(members, near["a"] == members["class_id"], "left").select(F.coalesce("own", "a").alias("id_a"), "id_b", "cosine")
    return same.unionByName(other)
