"""Exact top-k search by inner product with pivot-table elimination.

Distances from every vector to zero and to some pivots are worked out once. They place a vector x at a
point (a, h): its coordinates in the span of the pivots and its distance from that span. |q - x| is at
least the distance of the points of q and x, which is the largest lower bound that the table's distances
allow (larger than |d(q, p) - d(x, p)| for any pivot p), so the inner product is at most a.a' + h h'.

Vectors are dealt out to cells by their nearest pivot. A query first meets its own cell, which gives it a
k-th best score; a cell whose pivot p and radius r allow no such score, as q.p + |q| r is less, isn't
visited at all. Elsewhere candidates are evaluated in order of their bounds until no bound reaches the
k-th best score. Queries and candidates meet in blocks of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Pivots, rows in a block of candidates and of queries, candidates that are evaluated between two looks at the bounds.
PIVOTS, CANDIDATE_ROWS, QUERY_ROWS, STEP = 48, 2048, 1024, 64
#: A pivot counts if so much of it lies outside of the span of those before it; the share that rounding can take off a bound.
LEAST_NEW, SLACK = 0.05, 1e-7
_LONGEST = 2**63


def quantised(vector: Column) -> Column:
    """floor(256 x) of each component, as bigint. A component that doesn't fit raises."""
    scaled = lambda x: F.lit(256.0) * x.cast("double")
    return F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < float(_LONGEST), F.floor(scaled(x)).cast("long")).when(x.isNotNull(), F.raise_error(F.lit("a component doesn't fit 64 bits")).cast("long")))


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(fine, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), dim)


class Pivots:
    """The pivots of one length of vectors."""

    def __init__(self, rows: list[list[int]]):
        new, basis = [], np.zeros((0, len(rows[0]) if rows else 0))
        for row in rows:
            p = np.array(row, np.float64)
            rest = p - basis.T @ (basis @ p)
            if (size := np.linalg.norm(rest)) > LEAST_NEW * np.linalg.norm(p):
                basis = np.vstack([basis, rest / size])
                new.append(p)
        self.points = np.array(new).reshape(len(new), basis.shape[1])
        self.squares = (self.points**2).sum(axis=1)
        self.solve = np.linalg.inv(np.linalg.cholesky(self.points @ self.points.T)) if new else np.zeros((0, 0))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, h) of each row of x, the number of its nearest pivot, and its distance from that. Without
        a pivot the cell is -1, around zero."""
        x = x.astype(np.float64)
        square = (x**2).sum(axis=1)
        if not len(self.points):
            return np.sqrt(square)[:, None], np.full(len(x), -1), np.sqrt(square)
        d = np.sqrt(((x[:, None, :] - self.points[None]) ** 2).sum(axis=2))
        a = ((square[:, None] + self.squares - d**2) / 2) @ self.solve.T
        h = np.sqrt(np.maximum(0, square - (a**2).sum(axis=1)))
        cell = d.argmin(axis=1)
        return np.hstack([a, h[:, None]]), cell, d[np.arange(len(x)), cell]


def pivots_of(vectors: DataFrame, pivots: int = PIVOTS) -> dict[int, Pivots]:
    """The pivots by length: the rows with the least hashes."""
    chosen = [x["v"] for x in vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(pivots).collect()]
    return {n: Pivots([v for v in chosen if len(v) == n]) for n in {len(v) for v in chosen}}


def pivot_table(vectors: DataFrame, pivots: dict[int, Pivots]) -> DataFrame:
    """vec_id, dim, v (bytes of the integer vector), at (bytes of its point), cell and far (distance from
    the cell's pivot) from (vec_id, v array of bigint)."""

    def run(batches):
        for batch in batches:
            values = batch.column(1)
            dims = np.array([len(v) for v in values], np.int64)
            raw, points = [b""] * len(dims), [b""] * len(dims)
            cells, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for n in np.unique(dims).tolist():
                own = np.flatnonzero(dims == n)
                x = values.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(own), n)
                at, cells[own], far[own] = pivots.get(n, Pivots([])).place(x)
                for i, row, point in zip(own.tolist(), x, at):
                    raw[i], points[i] = row.astype("<i8").tobytes(), point.astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims.astype(np.int32)), pa.array(raw, pa.binary()), pa.array(points, pa.binary()), pa.array(cells), pa.array(far)], ["vec_id", "dim", "v", "at", "cell", "far"])

    return vectors.mapInArrow(run, "vec_id long, dim int, v binary, at binary, cell int, far double")


def _top(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -s))[:k]


def best_of(q: np.ndarray, x: np.ndarray, aq: np.ndarray, ax: np.ndarray, qid: np.ndarray, xid: np.ndarray, k: int, limit: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """For each query those of its k best candidates of the block that reach its limit, as (query ids,
    candidate ids, scores); and how many pairs were evaluated."""
    peak = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    kind = np.float32 if peak < 2**24 else np.float64 if peak < 2**53 else np.int64 if peak < 2**62 else object  # exact in each case
    qk, xk = q.astype(kind), x.astype(kind)
    nq, nx = np.sqrt((aq**2).sum(axis=1)), np.sqrt((ax**2).sum(axis=1))
    upper = aq @ ax.T + SLACK * (1 + nq[:, None] * nx[None, :])
    out, evaluated = [], 0
    for i in range(len(q)):
        open_ = np.flatnonzero((upper[i] >= limit[i]) & (xid != qid[i]))  # equal bounds stay: a tie can go to a smaller id
        open_ = open_[np.argsort(-upper[i, open_], kind="stable")] if len(open_) > STEP else open_
        ids, scores, low, at = xid[:0], np.zeros(0, object if kind is object else np.int64), limit[i], 0
        while at < len(open_) and upper[i, open_[at]] >= low:
            here = open_[at : at + STEP]
            at += len(here)
            evaluated += len(here)
            s = xk[here] @ qk[i]
            ids, scores = np.concatenate([ids, xid[here]]), np.concatenate([scores, s if kind is object else s.astype(np.int64)])
            best = _top(scores, ids, k)
            ids, scores = ids[best], scores[best]
            if len(scores) == k:
                low = max(low, float(scores[-1]) - SLACK * abs(float(scores[-1])))
        if kind is object and any(abs(s) >= _LONGEST for s in scores):
            raise OverflowError(f"a score of query {qid[i]} doesn't fit 64 bits")
        out.append((np.full(len(ids), qid[i]), ids, scores.astype(np.int64)))
    return out, evaluated


def _meet(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the best candidates that queries find in the cells that they name. left has
    vec_id, dim, cell, v, at and limit; right is a pivot table."""
    asked = left.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("long").alias("parts"))
    sizes = materialise(right.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / CANDIDATE_ROWS).cast("long").alias("blocks")).join(asked, ["dim", "cell"]), "sizes")
    zero, keys = F.lit(0).cast("long"), ["dim", "cell", "q", "c"]
    spread = lambda salt: F.xxhash64(F.lit(salt), "vec_id", "v")
    a = left.join(sizes, ["dim", "cell"]).select("vec_id", "dim", "cell", "v", "at", "limit", F.pmod(spread(3), F.col("parts")).alias("q"), F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("c"))
    b = right.join(sizes, ["dim", "cell"]).select("vec_id", "dim", "cell", "v", "at", F.pmod(F.xxhash64(F.lit(7), "vec_id", "v", F.monotonically_increasing_id()), F.col("blocks")).alias("c"), F.explode(F.sequence(zero, F.col("parts") - 1)).alias("q"))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if len(a) and len(b):
            dim = a.column("dim")[0].as_py()
            side = lambda t: (_matrix(t.column("v").combine_chunks(), dim), np.frombuffer(b"".join(t.column("at").to_pylist()), "<f8").reshape(len(t), -1), t.column("vec_id").to_numpy())
            (q, aq, qid), (x, ax, xid) = side(a), side(b)
            limit = np.array([-np.inf if v is None else v for v in a.column("limit").to_pylist()])
            found, _ = best_of(q, x, aq, ax, qid, xid, k, limit)
        cat = lambda j: np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64)
        return pa.table({"query_id": pa.array(cat(0), pa.int64()), "vec_id": pa.array(cat(1), pa.int64()), "score": pa.array(cat(2), pa.int64())})

    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")


def _open_cells(cells: dict[int, list[tuple[int, float]]], pivots: dict[int, Pivots]):
    """For each query the other cells whose pivot and radius allow a score that reaches its limit."""

    def run(batches):
        for batch in batches:
            dims, own = batch.column("dim").to_pylist(), batch.column("cell").to_pylist()
            raw, limits = batch.column("v").to_pylist(), batch.column("limit").to_pylist()
            at, named = [], []
            for i, (dim, cell, v, limit) in enumerate(zip(dims, own, raw, limits)):
                q = np.frombuffer(v, "<i8").astype(np.float64)
                size, points = np.linalg.norm(q), pivots.get(dim, Pivots([])).points
                near = points @ q if len(points) else np.zeros(0)
                for c, radius in cells.get(dim, ()):
                    most = (near[c] if c >= 0 else 0.0) + size * radius * (1 + SLACK) + SLACK * size * size + 1
                    if c != cell and (limit is None or most >= limit):
                        at.append(i)
                        named.append(c)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(named, pa.int32()) if n == "cell" else rows.column(n) for n in batch.schema.names], batch.schema.names)

    return run


def search(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each query by inner product of the
    integer vectors, the query's own id excluded, ties to the smaller vec_id; all if fewer.

    vectors has vec_id and v (array of bigint, see quantised and usable). Rows without a vec_id or v take
    no part. Vectors are compared with those of their own length only. Rows that share a vec_id are each
    a candidate; as a query the one with the least v stands for them. Products are exact at any size; one
    among the best that doesn't fit 64 bits raises. What comes to the driver are the pivots, and one row
    for each length of vectors and pivot."""
    base = vectors.where("vec_id is not null and v is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    chosen = pivots_of(base, pivots)
    held = materialise(pivot_table(base, chosen), "pivots")
    cells: dict[int, list[tuple[int, float]]] = {}
    for r in held.groupBy("dim", "cell").agg(F.max("far").alias("radius")).collect():
        cells.setdefault(r["dim"], []).append((r["cell"], r["radius"]))
    one = F.min_by(F.struct("dim", "v", "at", "cell"), F.struct("v", "dim")).alias("x")
    queries = materialise(held.where(is_query).groupBy("vec_id").agg(one).select("vec_id", "x.dim", "x.cell", "x.v", "x.at"), "queries")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    near = materialise(_meet(queries.withColumn("limit", F.lit(None).cast("double")), held, k), "near")
    best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("limit"))
    known = queries.join(best, "vec_id", "left").select("vec_id", "dim", "cell", "v", "at", "limit")
    far = materialise(known.mapInArrow(_open_cells(cells, chosen), "vec_id long, dim int, cell int, v binary, at binary, limit double"), "asked")
    every = near.unionByName(_meet(far, held, k))
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
