"""Benchmark decontamination by SimHash over item-sized windows and a multi-index on Hamming blocks.

A window has as many words as a benchmark item. Its SimHash sums its words' weighted bit vectors.
Fingerprints within RADIUS of each other agree up to RADIUS // BLOCKS bits in one of BLOCKS blocks
at least, so a table of each block's close values finds every item within the radius. Those are
verified by the exact weighted Jaccard similarity of five-word shingles.

Windows are fingerprinted only where they can reach the similarity at all: shared shingles must
make up that share of the window's own weight. This bound loses nothing that verification keeps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern.llm.common import bound_batches, core, mix, numbered, session, shingle_hashes, word_hashes

WORDS, SIMILARITY = 5, 0.8
RADIUS, BLOCKS = 15, 4
#: Items, and characters of items, in one pass; a larger benchmark takes further passes over the documents.
ITEMS_A_PASS, CHARS_A_PASS = 5000, 8_000_000
#: Words of a text that are fingerprinted at once.
SLICE = 8192
_SCALE = 64


def counted(hashes: np.ndarray, off: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Items that have words, their distinct words in order, and how many items hold each."""
    seen = [np.unique(hashes[a:b]) for a, b in zip(off[:-1], off[1:], strict=True) if b > a]
    return len(seen), *np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint64), return_counts=True)


class Index:
    """What a pass needs of its items; its size is bounded by ITEMS_A_PASS and the items' lengths.

    `known`: the word counts of the whole benchmark, if there are other passes, so that a word weighs
    the same in each.
    """

    def __init__(self, ids: list, texts: list[str], known: tuple[int, bytes, bytes] | None = None):
        hashes, off, _, _ = word_hashes(pa.array(texts, pa.string()))
        keep = np.flatnonzero(np.diff(off) > 0)
        self.ids = [ids[i] for i in keep]
        self.words = [hashes[off[i] : off[i + 1]] for i in keep]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        items, self.vocabulary, there = counted(hashes, off) if known is None else (known[0], np.frombuffer(known[1], np.uint64), np.frombuffer(known[2], np.int64))
        self.unseen = int(round(_SCALE * np.log1p(items)))
        self.weights = np.round(_SCALE * np.log1p(items / (1.0 + there))).astype(np.int64)
        self.prints = np.array([self.fingerprints(w, np.array([0]), len(w))[0] for w in self.words], np.uint64)
        # shingles of full length, and whole items that are shorter than one
        self.seeds = {k: np.unique(np.concatenate([self.shingles(w)[0] for w in self.words if min(len(w), WORDS) == k])) for k in np.unique(np.minimum(self.sizes, WORDS))}
        self.tables = self._tables()

    def weigh(self, words: np.ndarray) -> np.ndarray:
        """Words that many items hold weigh less; words of no item weigh most."""
        if not len(self.vocabulary):
            return np.full(len(words), self.unseen, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, self.weights[at], self.unseen)

    def shingles(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes of one run of words and their weights, the sums of their words' weights."""
        hashes, _ = shingle_hashes(words, np.array([0, len(words)]), WORDS)
        total = np.concatenate([[0], np.cumsum(self.weigh(words))])
        k = min(WORDS, len(words))
        return hashes, total[k:] - total[:-k]

    def fingerprints(self, words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """SimHash of the windows of `size` words at `starts`; integer sums, so alike wherever a window stands."""
        bits = ((mix(words ^ np.uint64(0x5BD1E995))[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int32)
        signed = (2 * bits - 1) * self.weigh(words).astype(np.int32)[:, None]
        total = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(signed, 0, dtype=np.int64)])
        on = total[starts + size] - total[starts] > 0
        return np.packbits(on, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)

    def _tables(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block: offsets by its 16-bit value, and the items whose block is within RADIUS // BLOCKS of it."""
        flips = [0]
        for n in range(1, RADIUS // BLOCKS + 1):
            flips += [sum(1 << b for b in c) for c in combinations(range(16), n)]
        flips = np.array(flips, np.int64)
        out = []
        for b in range(BLOCKS):
            own = ((self.prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            near = (own[:, None] ^ flips[None]).ravel()
            order = np.argsort(near, kind="stable")
            out.append((np.searchsorted(near[order], np.arange(65537)), (order // len(flips)).astype(np.int64)))
        return out

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) with fingerprints at most RADIUS apart."""
        windows, items = [], []
        for b, (off, near) in enumerate(self.tables):
            key = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            n = off[key + 1] - off[key]
            w = np.repeat(np.arange(len(prints)), n)
            i = near[np.repeat(off[key], n) + np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n)]
            close = np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS
            windows.append(w[close])
            items.append(i[close])
        pairs = np.unique(np.concatenate(windows) * len(self.ids) + np.concatenate(items))
        return pairs // max(len(self.ids), 1), pairs % max(len(self.ids), 1)

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Exact weighted Jaccard similarity of two runs of words."""
        sides = [self.shingles(window), self.shingles(self.words[item])]
        shingles = np.concatenate([s for s, _ in sides])
        weights = np.concatenate([w for _, w in sides])
        unique, inverse = np.unique(shingles, return_inverse=True)
        left = np.bincount(inverse[: len(sides[0][0])], minlength=len(unique))
        right = np.bincount(inverse[len(sides[0][0]) :], minlength=len(unique))
        weight = np.zeros(len(unique))
        weight[inverse] = weights
        total = (weight * np.maximum(left, right)).sum()
        return float((weight * np.minimum(left, right)).sum() / total) if total else 0.0

    def search(self, texts: pa.Array, similarity: float) -> list[tuple[int, int, int, int, int, float]]:
        """(text, item, first word, words, Hamming distance, similarity): each text's best window for each item it holds."""
        hashes, off, _, _ = word_hashes(texts)
        found: dict[tuple[int, int], tuple] = {}
        if not len(hashes) or not self.ids:
            return []
        hits = {}
        for k, seeds in self.seeds.items():
            shingles, s_off = shingle_hashes(hashes, off, int(k))
            hit = member(shingles, seeds)
            for text in np.unique(np.searchsorted(s_off, np.flatnonzero(hit), "right") - 1):
                hits.setdefault(int(text), {})[int(k)] = hit[s_off[text] : s_off[text + 1]]
        for text, own in hits.items():
            words = hashes[off[text] : off[text + 1]]
            total = np.concatenate([[0], np.cumsum(self.weigh(words))])
            for size in np.unique(self.sizes):
                k, m = min(int(size), WORDS), min(int(size), len(words))
                if k not in own or m < k:
                    continue
                weight = total[k:] - total[:-k]
                all_w = np.concatenate([[0], np.cumsum(weight)])
                hit_w = np.concatenate([[0], np.cumsum(weight * own[k])])
                span = m - k + 1
                share = hit_w[span:] - hit_w[:-span]
                starts = np.flatnonzero((share > 0) & (share >= similarity * (all_w[span:] - all_w[:-span])))
                if not len(starts):
                    continue
                # close starts together, at most SLICE words: this bounds the memory of very long texts
                apart = (np.diff(starts) > 256) | (np.diff(starts // SLICE) > 0)
                for run in np.split(starts, np.flatnonzero(apart) + 1):
                    prints = self.fingerprints(words[run[0] : run[-1] + m], run - run[0], m)
                    for w, i in zip(*self.within(prints), strict=True):
                        if self.sizes[i] != size:
                            continue
                        start = int(run[w])
                        s = self.similarity(words[start : start + m], int(i))
                        if s >= similarity and (best := found.get((text, int(i)))) is None or s >= similarity and (-s, start) < (-best[3], best[0]):
                            found[text, int(i)] = (start, m, int(np.bitwise_count(prints[w] ^ self.prints[i])), s)
        return [(text, item, *best) for (text, item), best in sorted(found.items())]


def member(values: np.ndarray, sorted_set: np.ndarray, bits: int = 22) -> np.ndarray:
    """Which values are in a sorted set; a bitmap over leading bits spares most searches."""
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    shift = np.uint64(64 - bits)
    table = np.zeros(1 << bits, bool)
    table[(sorted_set >> shift).astype(np.int64)] = True
    out = table[(values >> shift).astype(np.int64)]
    maybe = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(sorted_set, values[maybe]), len(sorted_set) - 1)
    out[maybe] = sorted_set[at] == values[maybe]
    return out


@lru_cache(maxsize=2)
def _index(ids: tuple, texts: tuple, known: tuple[int, bytes, bytes] | None) -> Index:
    return Index(list(ids), list(texts), known)


def passes(benchmark: DataFrame, item_col: str, text_col: str, items_a_pass: int) -> Iterator[tuple[tuple, tuple, tuple | None]]:
    """The items in blocks of about items_a_pass items and CHARS_A_PASS characters at most, and the word counts of all.

    The counts, 16 bytes for each distinct word of the benchmark, go with every block; of a single
    block they are its own and left out.
    """
    items = core(benchmark, item_col, text_col).where(F.length(F.trim(F.col(f"`{text_col}`"))) > 0).distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.col(f"`{text_col}`"))), F.lit(0)).alias("chars")).first()
    blocks = max(-(-size["n"] // items_a_pass), -(-size["chars"] // CHARS_A_PASS))

    def block(b: int) -> tuple[tuple, tuple]:
        rows = (items if blocks == 1 else items.where(F.pmod(F.xxhash64(item_col, text_col), F.lit(blocks)) == b)).collect()
        rows = sorted(((r[0], r[1]) for r in rows), key=str)
        return tuple(r[0] for r in rows), tuple(r[1] for r in rows)

    known = None
    if blocks > 1:
        total, words, counts = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in range(blocks):
            hashes, off, _, _ = word_hashes(pa.array(block(b)[1], pa.string()))
            n_items, own, there = counted(hashes, off)
            total += n_items
            words, at = np.unique(np.concatenate([words, own]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, there]), len(words)).astype(np.int64)
        known = (total, words.tobytes(), counts.tobytes())
    for b in range(blocks):
        yield *block(b), known


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """Benchmark items found in documents: id, item, first word, words, Hamming distance and similarity.

    One row for each row of `docs` and item with a window of at least this similarity: its best
    window, the first on a tie. A text shorter than an item is one window as a whole. Items and
    texts without words match nothing; an item of under five words must stand word for word. Items
    with a null id are searched like others, repeated items once.
    """
    spark = session(docs)
    bound_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    item_type = benchmark.schema[item_col].dataType
    schema = f"`{id_col}` {id_type}, `{item_col}` {item_type.simpleString()}, start long, words long, hamming int, similarity double"
    item_arrow = to_arrow_type(item_type)
    out = spark.createDataFrame([], schema)
    for ids, texts, known in passes(benchmark, item_col, item_text_col, items_a_pass):
        shared = spark.sparkContext.broadcast((ids, texts, known))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(*shared.value)
            item_ids = pa.array(index.ids, item_arrow)
            for batch in batches:
                got = index.search(batch.column(1), similarity)
                cols = list(zip(*got, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0], pa.int64())), item_ids.take(pa.array(cols[1], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[2:], (pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True))],
                    [id_col, item_col, "start", "words", "hamming", "similarity"],
                )

        out = out.union(core(docs, id_col, text_col).mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """The documents that hold no benchmark item; rows and columns are unchanged, without any shuffle."""
    spark = session(docs)
    bound_batches(spark)
    at = docs.columns.index(text_col)
    out = numbered(docs)
    schema = out.schema
    for ids, texts, known in passes(benchmark, item_col, item_text_col, items_a_pass):
        shared = spark.sparkContext.broadcast((ids, texts, known))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(*shared.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for text, *_ in index.search(batch.column(at), similarity):
                    clean[text] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, schema)
    return out.toDF(*docs.columns)
