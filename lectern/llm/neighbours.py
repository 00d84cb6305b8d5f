"""Nearest neighbours by vantage-point trees, one per shard, searched for blocks of queries at once.

A node splits its vectors by their distance to a vantage point. A child whose distances lie in
[lo, hi] can hold nothing nearer to a query at distance d than max(d - hi, lo - d). It is passed
over when that exceeds `factor` times the query's k-th distance so far; factor 1 is exact search,
smaller factors prune more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a tree and queries of a block: what one task holds, whatever the input.
SHARD_ROWS, BLOCK_QUERIES, LEAF = 8192, 4096, 128


class Tree:
    """A vantage-point tree; equal vectors are kept only as often as a result could use them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, leaf: int = LEAF):
        raw = np.ascontiguousarray(vectors).view([("", vectors.dtype)] * vectors.shape[1]).ravel()
        _, same = np.unique(raw, return_inverse=True)
        order = np.lexsort((ids, same))
        same, sorted_ids = same[order], ids[order]
        new = np.ones(len(order), bool)
        new[1:] = (same[1:] != same[:-1]) | (sorted_ids[1:] != sorted_ids[:-1])  # repeated rows
        order, same = order[new], same[new]
        first = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
        nth = np.arange(len(same)) - np.repeat(first, np.diff(np.append(first, len(same))))
        keep = order[nth <= k]  # k of them and perhaps the query itself
        self.ids, self.x = ids[keep], vectors[keep]
        with np.errstate(over="ignore"):
            self.squares = (self.x**2).sum(1)
        self.leaf = leaf
        self.root = self._build(np.arange(len(keep)))

    def _build(self, at: np.ndarray) -> tuple:
        if len(at) <= self.leaf:
            return ("leaf", at)
        d = distances(self.x[at], self.x[at[0]][None])
        middle = np.median(d)
        inner = d <= middle
        if inner.all():
            inner = d < middle
            if not inner.any():
                return ("leaf", at)
        parts = [(d[m].min(), d[m].max(), self._build(at[m])) for m in (inner, ~inner)]
        return ("node", at[0], *parts)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of each query's k nearest vectors with another id, padded with inf and -1."""
        with np.errstate(over="ignore"):
            self.q, self.q_ids, self.q_squares = queries, query_ids, (queries**2).sum(1)
        self.best_d = np.full((len(queries), k), np.inf)
        self.best_i = np.full((len(queries), k), np.iinfo(np.int64).max)  # behind any other at an infinite distance
        self.seen = np.full(len(queries), -1, np.int64)
        everyone = np.arange(len(queries))
        self._seed(self.root, everyone)
        self._visit(self.root, everyone, factor)
        return self.best_d, np.where(self.best_i == np.iinfo(np.int64).max, -1, self.best_i)

    def _seed(self, node: tuple, active: np.ndarray) -> None:
        """Take every query to one leaf, so that the search starts with bounds."""
        if not len(active):
            return
        if node[0] == "leaf":
            self._scan(node[1], active)
            self.seen[active] = node[1][0] if len(node[1]) else -1
            return
        d = distances(self.q[active], self.x[node[1]][None])
        inner = self._bound(d, node[2]) <= self._bound(d, node[3])
        self._seed(node[2][2], active[inner])
        self._seed(node[3][2], active[~inner])

    @staticmethod
    def _bound(d: np.ndarray, part: tuple) -> np.ndarray:
        return np.maximum(np.maximum(d - part[1], part[0] - d), 0)

    def _visit(self, node: tuple, active: np.ndarray, factor: float) -> None:
        if node[0] == "leaf":
            if len(node[1]):
                self._scan(node[1], active[self.seen[active] != node[1][0]])
            return
        d = distances(self.q[active], self.x[node[1]][None])
        for part in (node[2], node[3]):
            far = self.best_d[active, -1]
            go = ~(self._bound(d, part) > factor * far * (1 + 1e-12) + 1e-300)  # also where both overflow
            if go.any():
                self._visit(part[2], active[go], factor)

    def _scan(self, at: np.ndarray, active: np.ndarray) -> None:
        """Compare queries with a leaf: by products first, exactly where those come near the bound."""
        if not len(active) or not len(at):
            return
        k = self.best_d.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):  # what overflows is not finite, and compared exactly
            rough = self.q_squares[active][:, None] + self.squares[at][None] - 2 * (self.q[active] @ self.x[at].T)
            slack = 1e-9 * (self.q_squares[active][:, None] + self.squares[at][None])
            close = ~(rough - slack > self.best_d[active, -1][:, None] ** 2) & (self.q_ids[active][:, None] != self.ids[at][None])
        row, col = np.nonzero(close)
        if not len(row):
            return
        d = distances(self.q[active[row]], self.x[at[col]])
        touched = np.unique(row)
        who = np.concatenate([row, np.repeat(touched, k)])
        d = np.concatenate([d, self.best_d[active[touched]].ravel()])
        i = np.concatenate([self.ids[at[col]], self.best_i[active[touched]].ravel()])
        order = np.lexsort((i, d, who))
        who, d, i = who[order], d[order], i[order]
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        top = nth < k
        self.best_d[active[who[top]], nth[top]] = d[top]
        self.best_i[active[who[top]], nth[top]] = i[top]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows in double precision, components summed in their order."""
    with np.errstate(over="ignore", invalid="ignore"):
        gap = a - b
        gap *= gap
        total = np.zeros(len(gap))
        for column in gap.T:
            total += column
    odd = np.flatnonzero(~np.isfinite(total))
    if len(odd):  # squares beyond the range of doubles: the same sums of vectors divided by a power of two
        a, b = np.broadcast_to(a, gap.shape)[odd], np.broadcast_to(b, gap.shape)[odd]
        power = np.frexp(np.maximum(np.abs(a).max(1), np.abs(b).max(1)))[1] + 1
        gap = np.ldexp(a, -power[:, None]) - np.ldexp(b, -power[:, None])
        with np.errstate(over="ignore"):
            scaled = np.ldexp(np.sqrt(np.add.accumulate(gap * gap, axis=1)[:, -1]), power)
        out = np.sqrt(total)
        out[odd] = scaled
        return out
    return np.sqrt(total)


def valid(vector: Column) -> Column:
    """Whether a vector takes part: neither null, empty nor zero, all components finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pc.list_flatten(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), the neighbour's id and score (its Euclidean distance), nearest first, ties to the smaller id.

    Vectors that are null, zero or empty, hold a null or non-finite component or have a null id take
    no part, on either side; vectors of different lengths are never compared. A query's own id is no
    candidate. Repeated rows count once; of a query id with several vectors one is used. Shards are
    dealt by a hash of the id, so every task holds about shard_rows vectors and block_queries queries.
    """
    if not 0 < factor <= 1:
        raise ValueError("factor must lie in (0, 1]")

    def prepared(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector_col}`")
        return df.where(valid(v) & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<double>").alias("v"))

    base, asked = prepared(vectors), prepared(queries).groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    shards = max(1, -(-base.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block_queries))

    def dealt(df: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64(F.lit(own), "id"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    left = dealt(base, "shard", shards, "block", blocks).groupBy("dim", "shard", "block")
    right = dealt(asked, "block", blocks, "shard", shards).groupBy("dim", "shard", "block")

    def run(candidates: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list = [[], [], []]
        if candidates.num_rows and wanted.num_rows:
            ids = wanted.column("id").to_numpy()
            d, i = Tree(candidates.column("id").to_numpy(), matrix(candidates.column("v")), k).search(ids, matrix(wanted.column("v")), k, factor)
            row, col = np.nonzero(np.isfinite(d) | (i != -1))  # a distance beyond the range of doubles is infinite
            out = [ids[row], i[row, col], d[row, col]]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), id_col: pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    found = left.cogroup(right).applyInArrow(run, f"query_id long, `{id_col}` long, score double")
    order = Window.partitionBy("query_id").orderBy("score", id_col)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")
