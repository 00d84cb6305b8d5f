"""Vector codes: a codebook of whole numbers for each of 16 parts, searched by partial distances.

The nearest entry of a part is found dimension by dimension, those in which the codebook varies
most first. An entry's distance so far only grows, so an entry is dropped as soon as it exceeds the
smallest complete distance known; equal entries stay, and the lowest of them wins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import written
from lectern.llm.neighbours import matrix

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Whole components are held within this bound, so that squared errors fit a long.
LARGEST = 1 << 25
#: Vectors searched at once.
BLOCK = 2048


def whole(vectors: np.ndarray, parts: int = PARTS, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as (vectors, parts, width), the last part padded with zeros where parts don't divide the length."""
    width = -(-vectors.shape[1] // parts)
    out = np.zeros((len(vectors), parts * width), np.int64)
    with np.errstate(over="ignore"):
        out[:, : vectors.shape[1]] = np.clip(np.floor(vectors * scale), -LARGEST, LARGEST)
    return out.reshape(len(vectors), parts, width)


def search(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry of one codebook, ties to the lower, and its squared distance."""
    if not book.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    order = np.argsort(-book.astype(np.float64).var(0), kind="stable")
    x, book = x[:, order], book[:, order]
    nearest, least = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for at in range(0, len(x), BLOCK):
        own = x[at : at + BLOCK]
        partial = (own[:, :1] - book[None, :, 0]) ** 2
        best = ((own - book[partial.argmin(1)]) ** 2).sum(1)
        row, entry = np.nonzero(partial <= best[:, None])
        partial = partial[row, entry]
        for k in range(1, book.shape[1]):
            partial += (own[row, k] - book[entry, k]) ** 2
            if k + 1 < book.shape[1]:  # completing the most promising entry tightens the bound
                firsts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                lowest = np.minimum.reduceat(partial, firsts)
                hit = np.flatnonzero(partial == np.repeat(lowest, np.diff(np.append(firsts, len(row)))))
                np.minimum.at(best, row[hit], ((own[row[hit]] - book[entry[hit]]) ** 2).sum(1))
            stay = partial <= best[row]
            row, entry, partial = row[stay], entry[stay], partial[stay]
        firsts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        lowest = np.minimum.reduceat(partial, firsts)
        hit = np.flatnonzero(partial == np.repeat(lowest, np.diff(np.append(firsts, len(row)))))
        hit = hit[np.append(True, row[hit][1:] != row[hit][:-1])]  # entries ascend within a row
        nearest[at : at + BLOCK], least[at : at + BLOCK] = entry[hit], lowest
    return nearest, least


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of all parts and their squared distances, each as (vectors, parts)."""
    found = [search(x[:, p], books[p]) for p in range(len(books))]
    return np.stack([e for e, _ in found], 1), np.stack([d for _, d in found], 1)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component; zero vectors take part."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def first_vectors(base: DataFrame, n: int) -> np.ndarray:
    """The vectors of the n smallest ids; a task hands on its own n smallest, so the driver and one task see few."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i in np.unique(ids)[:n].tolist():
                if len(kept) < n or i in kept or i < max(kept):
                    for at in np.flatnonzero(ids == i).tolist():
                        v = batch.column(1)[at].as_py()
                        kept[i] = min(kept.get(i, v), v)
            for i in sorted(kept)[n:]:
                del kept[i]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(kept.values(), pa.list_(pa.float64()))], ["id", "v"])

    few = base.where("id IS NOT NULL").select("id", "v").mapInArrow(smallest, "id long, v array<double>")
    rows = few.groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(n).collect()
    return np.array([r["v"] for r in rows], np.float64)


def improved(base: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry becomes the floor of the mean of its parts; unused entries stay."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = whole(matrix(batch.column(0)), parts)
            chosen, _ = assigned(x, books)
            for p in range(parts):
                used[p] += np.bincount(chosen[:, p], minlength=entries)
                np.add.at(total[p], chosen[:, p], x[:, p])
        p, e = np.nonzero(used)
        at = np.repeat(np.arange(len(p)), width + 1)
        place = np.tile(np.arange(-1, width), len(p))  # -1: how many
        value = np.concatenate([used[p, e][:, None], total[p, e]], 1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(p[at], pa.int32()), pa.array(e[at], pa.int32()), pa.array(place, pa.int32()), pa.array(value, pa.int64())], ["part", "entry", "place", "value"])

    out = books.copy()
    rows = base.select("v").mapInArrow(sums, "part int, entry int, place int, value long").groupBy("part", "entry", "place").agg(F.sum("value").alias("value")).collect()
    count = {(r["part"], r["entry"]): r["value"] for r in rows if r["place"] < 0}
    for r in rows:
        if r["place"] >= 0:
            out[r["part"], r["entry"], r["place"]] = r["value"] // count[r["part"], r["entry"]]
    return out


def vector_codes(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The id, code, error, label_error and codebooks_sha256 of every vector without null or non-finite components.

    Other rows are dropped; zero vectors stay, repeated rows give a row each. Codebooks start from the
    smallest distinct ids (of an id with several vectors the least vector); rows with a null id start
    none but are coded, and where no row has an id, code, error and digest are null. Fewer vectors than
    entries give fewer entries. Vectors of another length have codebooks of their own; a length that 16
    does not divide is filled up with zeros. Whole components beyond 2^25 count as that. An error of a
    label beyond a long is null. An empty table gives no row; other columns are ignored.

    The driver holds codebooks and sums only, whose size does not grow with the rows; each round is one
    scan whose tasks hand on their sums of each entry.
    """
    named = {c: F.col(f"`{c}`") for c in (id_col, vector_col, label_col)}
    clean = vectors.where(usable(named[vector_col])).select(named[id_col].cast("long").alias("id"), named[vector_col].cast("array<double>").alias("v"), named[label_col].alias("label"))
    lengths = [r["n"] for r in clean.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()]
    schema = clean.select("id", "label").schema.add("code", "string").add("error", "long").add("codebooks_sha256", "string")

    def coded(length: int) -> DataFrame:
        base = clean.where(F.size("v") == length)
        firsts = first_vectors(base, entries)
        if not len(firsts):
            return base.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("string").alias("codebooks_sha256"))
        books = whole(firsts).transpose(1, 0, 2)
        for _ in range(rounds):
            books = improved(base, books)
        sha = digest(books)

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                chosen, d = assigned(whole(matrix(batch.column(2))), books)
                text = chosen.astype(np.uint8).tobytes().hex()
                size = 2 * PARTS
                code = [text[k : k + size] for k in range(0, len(text), size)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(d.sum(1), pa.int64()), pa.array([sha] * len(code), pa.string())], ["id", "label", "code", "error", "codebooks_sha256"])

        return base.select("id", "label", "v").mapInArrow(encode, schema)

    if not lengths:
        rows = clean.sparkSession.createDataFrame([], schema)
    else:
        rows = written(reduce(DataFrame.union, map(coded, lengths)), "codes")
    totals = rows.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    return rows.join(totals, rows.label.eqNullSafe(totals.of), "left").select(F.col("id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")


def _assign(books: str) -> str:
    return f"""SELECT p.vec_id, p.part, p.x, CAST(min(CAST(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS HUGEINT) * 64 + b.entry) AS HUGEINT) AS best
FROM p JOIN {books} b USING (part) GROUP BY p.vec_id, p.part, p.x"""


def _round(k: int) -> str:
    return f"""a{k} AS ({_assign(f"b{k}")}),
m{k} AS (SELECT part, CAST(best % 64 AS BIGINT) AS entry, pos, CAST(floor(sum(x[pos]) / count(*)) AS BIGINT) AS mean
         FROM a{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS pos) GROUP BY ALL),
g{k} AS (SELECT part, entry, list(mean ORDER BY pos) AS x FROM m{k} GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT b{k}.part, b{k}.entry, coalesce(g{k}.x, b{k}.x) AS x FROM b{k} LEFT JOIN g{k} USING (part, entry))"""


#: Of vectors of one length that 16 divides, with ids that differ.
ORACLE = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, e[part * len(e) // 16 + 1 : (part + 1) * len(e) // 16] AS x FROM kept, (SELECT unnest(range(16)) AS part)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept),
b0 AS MATERIALIZED (SELECT part, entry, x FROM p JOIN s USING (vec_id) WHERE entry < 64),
{",".join(_round(k) for k in range(ROUNDS))},
a AS ({_assign(f"b{ROUNDS}")}),
c AS (SELECT vec_id, string_agg(lower(printf('%02x', CAST(best % 64 AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c JOIN kept USING (vec_id), h
"""
