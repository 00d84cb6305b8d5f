"""Near duplicates among embeddings: exact threshold pairs by cover trees over cells, shard by shard.

The top of the cover tree is a set of at most 256 pivots from a bounded sample. Every vector belongs to
the cell of its nearest pivot and, within it, to a ring of halving radius; the innermost ring, the core,
lies within half the threshold of its pivot, so all its vectors link. Rings are cut into shards of
bounded size. A vector goes to those other shards that its angle to their pivot and the ring's measured
radii do not exclude, and counts for a whole ring at once where they prove that everything links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import fingerprint, mix, written
from lectern.llm.components import components
from lectern.llm.covers import SLACK, CoverTree, Links, angles, covering, dual, scaled, units
from lectern.llm.neighbours import matrix, valid

COSINE = 0.9
#: Vectors that the pivots are chosen from, and pivots; vectors of a tree; vectors that visit one copy of it.
SAMPLE, PIVOTS, SHARD_ROWS, VISITORS = 1024, 256, 4096, 1 << 18
CORE = 63
PARTIAL = "rep long, other long, n long"


def pivots_of(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Directions that cover the sample: the deepest level of halving radius with at most `most` of them."""
    u = units(scaled(sample))
    at, level = np.arange(len(u)), np.pi / 2
    chosen = at[:1]
    while level > SLACK:
        more = covering(u, at, level)[0]
        if len(more) > most:
            break
        chosen, level = more, level / 2
    return u[chosen]


class Cells:
    """The rings that hold vectors, in the order of their numbers, with what is known of each."""

    def __init__(self, rows: list, pivots: np.ndarray, cosine: float, shard_rows: int):
        rows = sorted(rows, key=lambda r: r["cell"])
        self.number, self.reps, self.weight, self.least = (np.array([r[c] for r in rows], np.int64) for c in ("cell", "reps", "weight", "least"))
        self.lo, self.hi = (np.array([r[c] for r in rows]) for c in ("lo", "hi"))
        self.pivots, self.t = pivots, float(np.arccos(cosine))
        self.pivot, self.core = self.number // 64, self.number % 64 == CORE
        self.shards = -(-self.reps // shard_rows)
        self.first = np.append(0, np.cumsum(self.shards))

    def homes(self, cell: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the cell and shard of each vector."""
        k = np.searchsorted(self.number, cell)
        return k, self.first[k] + (mix(ids.astype(np.uint64)) % self.shards[k].astype(np.uint64)).astype(np.int64)

    def met(self, u: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, cells): which later cells a vector may link with in part, and which it links with as a whole."""
        a = angles(u, self.pivots)[:, self.pivot]
        later = np.arange(len(self.number))[None] > k[:, None]
        near = later & (a - self.hi <= self.t + SLACK) & (self.lo - a <= self.t + SLACK)
        whole = near & (a + self.hi <= self.t - SLACK)
        return near & ~whole, whole


def _placed(pivots: np.ndarray, cosine: float):
    core = float(np.arccos(cosine)) / 2 - SLACK

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = angles(units(scaled(matrix(batch.column("v")))), pivots)
            pivot = a.argmin(1)
            own = a[np.arange(len(a)), pivot] if len(a) else np.zeros(0)
            ring = np.minimum(np.log2(np.pi / np.maximum(own, 1e-9)).astype(np.int64), CORE - 1)
            cell = pivot * 64 + np.where(own <= core, CORE, ring)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(own, pa.float64())], [*batch.schema.names, "cell", "angle"])

    return place


def _sent(cells: Cells, blocks: int):
    """Every vector to its own shard, once for each block, and to those it visits."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 20) // max(1, int(cells.first[-1]), len(cells.number)))
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, step):
                batch = whole_batch.slice(at, step)
                ids = batch.column("rep").to_numpy(zero_copy_only=False)
                k, home = cells.homes(batch.column("cell").to_numpy(), ids)
                block = (mix(ids.astype(np.uint64) ^ np.uint64(0x5BF03635)) % np.uint64(blocks)).astype(np.int64)
                row, cell = np.nonzero(cells.met(units(scaled(matrix(batch.column("v")))), k)[0])
                size = cells.shards[cell]
                to = np.repeat(cells.first[cell] - np.append(0, np.cumsum(size))[:-1], size) + np.arange(size.sum())
                row = np.repeat(row, size)
                rest = np.where(cells.core[k], 0, cells.first[k + 1] - home - 1)  # later shards of the own cell
                own = np.repeat(np.arange(len(ids)), rest)
                later = np.repeat(home + 1 - np.append(0, np.cumsum(rest))[:-1], rest) + np.arange(rest.sum())
                who = np.concatenate([np.repeat(np.arange(len(ids)), blocks), row, own])
                shard = np.concatenate([np.repeat(home, blocks), to, later])
                to_block = np.concatenate([np.tile(np.arange(blocks), len(ids)), block[row], block[own]])
                role = np.repeat([0, 1], [len(ids) * blocks, len(row) + len(own)])
                for part in range(0, len(who), 4096):
                    cut = slice(part, part + 4096)
                    taken = batch.select(["rep", "w", "v"]).take(pa.array(who[cut]))
                    yield pa.RecordBatch.from_arrays([pa.array(x[cut], pa.int32()) for x in (shard, to_block, role)] + taken.columns, ["shard", "block", "role", "rep", "w", "v"])

    return send


def _rows(ids: np.ndarray, root: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    said = (n > 0) | (ids != root)
    alone = ids[said] == root[said]
    return pa.RecordBatch.from_arrays([pa.array(ids[said], pa.int64()), pa.array(root[said], pa.int64(), mask=alone), pa.array(n[said], pa.int64())], ["rep", "other", "n"])


def _traversed(core_shards: np.ndarray, cosine: float):
    """One tree for each shard and block; its visitors come after it and are met some thousands at a time."""

    def settled(tree: CoverTree, ids: np.ndarray, guests: CoverTree | None, guest_ids: np.ndarray) -> pa.RecordBatch:
        links = Links([len(ids), len(guest_ids)])
        dual(tree, tree if guests is None else guests, links, 0, 0 if guests is None else len(ids), cosine)
        everyone = np.concatenate([ids[tree.order], guest_ids[guests.order] if guests is not None else guest_ids])
        return _rows(everyone, everyone[links.find(np.arange(len(everyone)))], links.count)

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, tree, ids = None, [], None, np.zeros(0, np.int64)

        def points(parts: list[pa.RecordBatch]):
            x = np.concatenate([scaled(matrix(p.column("v"))) for p in parts])
            return CoverTree(x, np.concatenate([p.column("w").to_numpy() for p in parts])), np.concatenate([p.column("rep").to_numpy() for p in parts])

        def built() -> Iterator[pa.RecordBatch]:
            nonlocal tree, ids
            if tree is None and home:
                tree, ids = points(home)
                if key[1] == 0 and not core_shards[key[0]]:
                    yield settled(tree, ids, None, np.zeros(0, np.int64))

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("shard", "block", "role")], 1)
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
                now, part = (int(keys[lo, 0]), int(keys[lo, 1])), batch.slice(lo, hi - lo)
                if now != key:
                    yield from built()
                    key, home, tree = now, [], None
                if keys[lo, 2] == 0:
                    home.append(part)
                else:
                    yield from built()
                    if tree is not None:
                        guests, guest_ids = points([part])
                        yield settled(tree, ids, guests, guest_ids)
        yield from built()

    return traverse


def _wholes(cells: Cells):
    """What vectors link with as whole cells: of each its weight and least id, and for the cells the weight that came."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        came = np.zeros(len(cells.number), np.int64)
        for batch in batches:
            ids = batch.column("rep").to_numpy()
            k, _ = cells.homes(batch.column("cell").to_numpy(), ids)
            row, cell = np.nonzero(cells.met(units(scaled(matrix(batch.column("v")))), k)[1])
            np.add.at(came, cell, batch.column("w").to_numpy()[row])
            yield pa.RecordBatch.from_arrays([pa.array(ids[row], pa.int64()), pa.array(cells.least[cell], pa.int64()), pa.array(cells.weight[cell], pa.int64())], ["rep", "other", "n"])
        hit = np.flatnonzero(came)
        yield pa.RecordBatch.from_arrays([pa.array([None] * len(hit), pa.int64()), pa.array(hit, pa.int64()), pa.array(came[hit], pa.int64())], ["rep", "other", "n"])

    return meet


def _linked(reps: DataFrame, sample: np.ndarray, cosine: float, shard_rows: int, visitors: int) -> tuple[DataFrame, DataFrame]:
    """Of vectors of one length: the placed table, and rows rep, other (linked with it, or null), n (linked weight)."""
    spark = reps.sparkSession
    pivots = pivots_of(sample)
    placed = written(reps.mapInArrow(_placed(pivots, cosine), "rep long, w long, v array<double>, h1 long, h2 long, cell long, angle double"), "placed")
    known = placed.groupBy("cell").agg(F.count("*").alias("reps"), F.sum("w").alias("weight"), F.min("rep").alias("least"), F.min("angle").alias("lo"), F.max("angle").alias("hi")).collect()
    cells = Cells(known, pivots, cosine, shard_rows)
    shards, blocks = int(cells.first[-1]), max(1, -(-int(cells.reps.sum()) // visitors))
    columns = placed.select("rep", "w", "v", "cell")
    sent = columns.mapInArrow(_sent(cells, blocks), "shard int, block int, role int, rep long, w long, v array<double>")
    dealt = sent.repartition(max(2, min(2 * shards * blocks, 20_000)), "shard", "block").sortWithinPartitions("shard", "block", "role")
    found = [dealt.mapInArrow(_traversed(np.repeat(cells.core, cells.shards), cosine), PARTIAL)]
    gains = {int(c): int(w) for c, w, core in zip(cells.number, cells.weight, cells.core, strict=True) if core}
    if (cells.hi <= cells.t).any():
        whole = written(columns.mapInArrow(_wholes(cells), PARTIAL), "wholes")
        found.append(whole.where("rep IS NOT NULL"))
        for r in whole.where("rep IS NULL").groupBy("other").agg(F.sum("n").alias("n")).collect():
            c = int(cells.number[r["other"]])
            gains[c] = gains.get(c, 0) + r["n"]
    if gains:
        least = dict(zip(cells.number.tolist(), cells.least.tolist(), strict=True))
        core = set(cells.number[cells.core].tolist())
        small = spark.createDataFrame([(c, least[c] if c in core else None, n) for c, n in gains.items()], "cell long, other long, n long")
        found.append(placed.select("rep", "cell").join(F.broadcast(small), "cell").select("rep", "other", "n"))
    return placed, reduce(DataFrame.union, found)


def embedding_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, visitors: int = VISITORS) -> DataFrame:
    """The id, n_links, component_id and kept of every row: how many other rows its vector links with, by cosine of at least `cosine`.

    component_id is the smallest id that links reach, kept tells whether that is the row's own. Rows with a
    null id, or with a vector that is null, empty, zero or holds a null or non-finite component, link with
    nothing: n_links 0, their own id, kept. Vectors of different lengths never link. Every row is a vector,
    also where rows repeat: equal vectors, told by a 128-bit fingerprint, are searched once and count as
    often as they stand. Components that square beyond the range of doubles are scaled first. An empty table
    gives no row; other columns are ignored.

    Pairs are found exactly. Where vectors lie scattered, shards meet each other and work grows with the
    square of the rows, each task holding one shard and at most about `visitors` guests.
    """
    if not 0 < cosine < 1:
        raise ValueError("cosine must lie between 0 and 1")
    v, spark = F.col(f"`{vector_col}`"), vectors.sparkSession
    takes_part = valid(v) & F.col(f"`{id_col}`").isNotNull()
    # the condition guards the fingerprint: a row that takes no part has none, and so meets no other
    halves = [F.when(takes_part, h) for h in fingerprint(v.cast("array<double>"))]
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<double>").alias("v"), halves[0].alias("h1"), halves[1].alias("h2"))
    clean = rows.where("h1 IS NOT NULL")
    reps = clean.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("w"), F.first("v").alias("v")).select("rep", "w", "v", "h1", "h2")
    placed, partial = [], []
    for r in clean.groupBy(F.size("v").alias("length")).count().orderBy("length").collect():
        own = clean.where(F.size("v") == r["length"])
        sample = matrix(own.select("v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow().column("v"))
        for into, part in zip((placed, partial), _linked(reps.where(F.size("v") == r["length"]), sample, cosine, shard_rows, visitors), strict=True):
            into.append(part)
    if not placed:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = written(reduce(DataFrame.union, partial), "links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    classes = components(found.where("other IS NOT NULL AND rep <> other"), "rep", "other")
    known = reduce(DataFrame.union, placed).select("h1", "h2", "rep").join(counts, "rep", "left").join(classes, F.col("rep") == F.col("node"), "left")
    known = known.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "n", F.coalesce("comp", "rep").alias("comp"))
    out = rows.select("id", "h1", "h2").join(known, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce(F.col("n") - 1, F.lit(0)).alias("n_links"), F.coalesce("comp", "id").alias("component_id"), F.coalesce("comp", "id").eqNullSafe(F.col("id")).alias("kept"))


ORACLE = f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS MATERIALIZED (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v),
l AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM n x JOIN n y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
      WHERE list_sum(list_transform(list_zip(x.e, y.e), lambda z: z[1] * z[2])) / (x.size * y.size) >= {COSINE}),
r AS (SELECT vec_id, vec_id AS node FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.node = l.a),
c AS (SELECT vec_id, min(node) AS component_id FROM r GROUP BY vec_id),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(k.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN k ON k.a = c.vec_id
"""
