"""Best-fit packing of tokenised documents by exact-complement hashing.

Pieces of one length are interchangeable, so the packing is solved on the histogram of lengths,
which has at most `capacity` rows whatever the corpus holds, and is then dealt out to the pieces
by rank: piece number r of a length takes slot number r of that length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import bound_batches, core, session, written
from lectern.llm.tokens import TOKENIZER, encoder

CAPACITY = 2048
SEPARATOR = 0


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of documents: each text's ids and then `separator`, cut only if longer than `capacity`.

    The first piece takes the remainder, all others are full. Null texts count as empty, so every
    row gives at least one piece. with_ids adds the ids themselves.
    """
    bound_batches(session(docs))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            row, piece, start, length, crc, tokens = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(enc(text or ""), np.uint32(separator)).astype("<u4")
                cut = len(ids) % capacity or capacity
                for k, a in enumerate([0, *range(cut, len(ids), capacity)]):
                    part = ids[a : cut if a == 0 else a + capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        tokens.append(part.astype(np.int32))
            out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                out.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)

    schema = f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return core(docs, id_col, text_col).mapInArrow(run, schema)


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns that together use every piece: ([(length, pieces of it in a sequence)], sequences).

    From the longest length down, the gap it leaves is looked up among the single lengths, then the
    sums of pairs, then of triples; each hit is used as often as all its lengths last. What no
    combination fills exactly is packed best-fit. Every step uses up a length or ends a gap's
    search, so the work depends on `capacity` only, not on the number of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    out: list[tuple[list[tuple[int, int]], int]] = []

    def use(lengths: list[int]) -> int:
        need = defaultdict(int)
        for x in lengths:
            need[x] += 1
        times = min(int(left[x]) // n for x, n in need.items())
        if times:
            for x, n in need.items():
                left[x] -= n * times
            out.append((sorted(need.items(), reverse=True), times))
        return times

    def pair(total: int, held: int = 0) -> tuple[int, int] | None:
        """Two lengths with this sum that are both there, the longest first; `held` is already taken once."""
        a = np.arange(total - 1, (total - 1) // 2, -1)
        b = total - a
        if held:
            left[held] -= 1
        ok = np.flatnonzero((left[a] > 0) & (left[b] > 0) & ((a != b) | (left[a] > 1)))
        if held:
            left[held] += 1
        return (int(a[ok[0]]), int(b[ok[0]])) if len(ok) else None

    if left[capacity]:
        use([capacity])
    residual: dict[int, int] = {}
    for length in range(capacity - 1, 0, -1):
        gap = capacity - length
        while left[length] > 0:
            left[length] -= 1  # the searches must not take the piece that leaves the gap
            found = [gap] if left[gap] > 0 else None
            if not found and gap > 1 and (two := pair(gap)):
                found = list(two)
            if not found and gap > 2:
                for a in np.flatnonzero(left[: gap - 1])[::-1]:
                    if a >= gap // 3 and (two := pair(gap - int(a), int(a))):
                        found = [int(a), *two]
                        break
            left[length] += 1
            if not found:
                residual[length] = int(left[length])
                left[length] = 0
                break
            use([length, *found])
    for length, n in residual.items():
        left[length] = n
    while left.any():
        free, need, room = left.copy(), defaultdict(int), capacity
        while room > 0 and len(fit := np.flatnonzero(free[: room + 1])):
            x = int(fit[-1])
            n = min(room // x, int(free[x]))
            free[x] -= n
            need[x] += n
            room -= n * x
        times = min(int(left[x]) // n for x, n in need.items())
        for x, n in need.items():
            left[x] -= n * times
        out.append((sorted(need.items(), reverse=True), times))
    return out


def slots(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, pieces per sequence, first offset), in order of rank."""
    rank: dict[int, int] = defaultdict(int)
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for length, n in lengths:
            out[length].append((rank[length], sequence, n, offset))
            rank[length] += n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(parts: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", rows_a_salt: int = 100_000) -> DataFrame:
    """Give every piece of `parts` (doc_id, piece, length, ...) a sequence_id and an offset, gapless from 0.

    No sequence exceeds `capacity`. `parts` must be materialised (see written()), since it is read
    twice. Pieces get their rank within a length from salted windows plus the salts' running counts,
    so that no length, however common, meets in one task. An empty table gives an empty table.
    """
    histogram = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = slots(solve(histogram, capacity))
    salts = max(64, -(-sum(histogram.values()) // rows_a_salt))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(salts)))
    before = (
        salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    ranked = salted.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_col, "piece", "ids_crc32"))).join(before, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_row") - 1).drop("_salt", "_row", "_before")
    names = [c for c in ranked.columns if c != "_rank"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                rows = table[int(one)]
                own = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                n = rank[at] - own[:, 0]
                sequence[at] = own[:, 1] + n // own[:, 2]
                offset[at] = own[:, 3] + n % own[:, 2] * one
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInArrow(deal, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, separator: int = SEPARATOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack documents: one row per piece.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and empty texts are
    one piece of the separator alone; repeated rows are packed each; a null id is kept.
    """
    parts = written(pieces(docs, capacity, tokenizer, separator, id_col, text_col), "pieces")
    return pack(parts, capacity, id_col).select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
