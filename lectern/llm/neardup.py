"""Near-duplicate classes by consistent weighted sampling over TF-IDF shingles.

Shingles of five words weigh term frequency times inverse document frequency. Improved consistent
weighted sampling draws from each text samples that two texts share with the probability of their
weighted Jaccard similarity; bands of samples give candidates, and the exact weighted Jaccard
similarity of the whole texts decides.

Document frequencies come from all documents, by a count-mean-min sketch: every shingle is counted in
SKETCH_ROWS tables of fixed size at places that independent hashes give, the even load of a table is
taken off, and the least count stands. An estimate is the same for a shingle wherever it stands, so
that the similarity is well defined. All frequencies below one document in RARE weigh alike, whatever
the number of documents, and so the load that the sketch cannot tell apart decides nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import bound_batches, core, dropped, mix, session, shingle_hashes, unused, word_hashes, written
from lectern.llm.components import components

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 3
#: The sketch of document frequencies: its rows, slots a row (as a power of two), slots a block; the frequency from which shingles weigh less.
SKETCH_ROWS, TABLE_BITS, BLOCK, RARE = 2, 20, 1 << 16, 1024


# Weights


def bags(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order of appearance, their frequencies in it, and the n + 1 offsets."""
    hashes, off, _, _ = word_hashes(texts)
    shingles, off = shingle_hashes(hashes, off, words)
    tf = np.ones(len(shingles), np.int64)
    if not len(shingles):
        return shingles, tf, off
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    key = shingles + mix(np.arange(1, len(off), dtype=np.uint64))[text]  # apart by text
    order = np.argsort(key)
    ranked = key[order]
    again = np.concatenate([[False], ranked[1:] == ranked[:-1]])
    if not again.any():
        return shingles, tf, off
    runs = np.flatnonzero(~again)
    keep = np.minimum.reduceat(order, runs)
    tf[keep] = np.diff(np.append(runs, len(order)))
    keep = np.sort(keep)
    return shingles[keep], tf[keep], np.searchsorted(keep, off).astype(np.int64)


def slots(shingles: np.ndarray) -> list[np.ndarray]:
    """The place of each shingle in every row of the sketch."""
    shift = np.uint64(64 - TABLE_BITS)
    return [((shingles if r == 0 else shingles * np.uint64(0x9E3779B97F4A7C15 + 2 * r)) >> shift).astype(np.int64) for r in range(SKETCH_ROWS)]


def frequencies(docs: DataFrame, text_col: str = "text", words: int = WORDS) -> tuple[np.ndarray, int]:
    """The sketch, SKETCH_ROWS tables of documents per slot, over all rows, and the number of rows.

    Every task counts into tables of its own; tables are summed by block in groups of tasks and then
    across groups, a block of sums in one row. The driver gets the tables once, whatever the input.
    """
    spark = session(docs)
    bound_batches(spark)
    size = SKETCH_ROWS << TABLE_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, rows = np.zeros(size, np.int32), 0
        for batch in batches:
            shingles, _, _ = bags(batch.column(0), words)
            for r, at in enumerate(slots(shingles)):
                table[r << TABLE_BITS : (r + 1) << TABLE_BITS] += np.bincount(at, minlength=1 << TABLE_BITS).astype(np.int32)
            rows += batch.num_rows
        if rows:
            context = TaskContext.get()
            party = context.partitionId() // 64 if context else 0
            for block in range(size // BLOCK):
                part = table[block * BLOCK : (block + 1) * BLOCK]
                small = np.min_scalar_type(int(part.max()))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([party], pa.int32()), pa.array([part.astype(small).tobytes()], pa.binary()), pa.array([small.itemsize], pa.int32()), pa.array([rows if block == 0 else 0], pa.int64())], ["block", "party", "counts", "width", "rows"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for x, width in zip(group.column("counts"), group.column("width").to_pylist(), strict=True):
            total += np.frombuffer(x.as_buffer(), f"u{width}").astype(np.int64)
        return pa.table({"block": group.column("block")[:1], "party": pa.array([group.column("party")[0].as_py() // 64], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary()), "width": pa.array([8], pa.int32()), "rows": pa.array([sum(group.column("rows").to_pylist())], pa.int64())})

    schema = "block int, party int, counts binary, width int, rows long"
    sums = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, schema)
    for _ in range(2):
        sums = sums.groupBy("block", "party").applyInArrow(add, schema)
    got = sums.collect()  # the tables once for each 4096 tasks
    table = np.zeros(size, np.int64)
    for r in got:
        table[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += np.frombuffer(r["counts"], np.int64)
    return table.reshape(SKETCH_ROWS, -1), sum(r["rows"] for r in got)


class Weights:
    """Inverse document frequencies of shingles, between 1 (in every document) and 2 (in fewer than one in RARE).

    Unscaled, what a large group of near copies shares would weigh so little, being frequent because
    of the copies, that a few edits took them apart.
    """

    def __init__(self, table: np.ndarray, rows: int):
        load = table.sum(1, keepdims=True)
        least = max(1.0, rows / RARE)
        there = np.clip(table - (load - table) / (table.shape[1] - 1), least, max(rows, least))
        self.table = (1 + np.log(max(rows, 1) / there) / np.log(max(min(rows, RARE), 2))).astype(np.float32)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """The weight by the least frequency, the largest of the rows' weights."""
        out = None
        for row, at in zip(self.table, slots(shingles), strict=True):
            own = row[at]
            out = own if out is None else np.maximum(out, own, out=out)
        return out


# Sampling


def _gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at (i + 1/2) / n."""
    u = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < u
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


_GAMMA = _gamma_quantiles()
_R, _INVERSE_R, _LOG_C = _GAMMA.astype(np.float32), (1 / _GAMMA).astype(np.float32), np.log(_GAMMA).astype(np.float32)


def samples(shingles: np.ndarray, weights: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """n consistent weighted samples of each text, as 64-bit values; texts without shingles get zeros.

    Per shingle and sample: r and c from Gamma(2, 1), b uniform, all by hash; t = floor(ln w / r + b);
    the shingle with the least ln c - r (t - b) - r is drawn, together with its t.
    """
    out = np.zeros((len(off) - 1, n), np.uint64)
    full = np.flatnonzero(np.diff(off))
    if not len(full):
        return out
    starts = off[:-1][full]
    log_w = np.log(weights).astype(np.float32)
    place = np.arange(len(shingles), dtype=np.uint64)
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    mask = np.uint64(0xFFFF)
    for k in range(n):
        x = (shingles ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        ri = (x & mask).astype(np.int32)
        ci = ((x >> np.uint64(16)) & mask).astype(np.int32)
        b = ((x >> np.uint64(32)) & mask).astype(np.float32)
        b *= np.float32(1 / 65536)
        r = _R[ri]
        t = log_w * _INVERSE_R[ri]
        t += b
        np.floor(t, out=t)
        a = t - b
        a += 1
        a *= r
        np.subtract(_LOG_C[ci], a, out=a)
        bits = a.view(np.int32)
        bits ^= (bits >> 31) & np.int32(0x7FFFFFFF)  # integers in the order of the floats
        key = ((bits.astype(np.int64) + (1 << 31)).astype(np.uint64) << np.uint64(32)) | place
        best = (np.minimum.reduceat(key, starts) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out[full, k] = mix(shingles[best] + t[best].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
    return out


def signatures(docs: DataFrame, idf: Weights, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """Per row: id, a 128-bit key of its bag of shingles (of its raw text, if it has no word), its band hashes and its weight in all."""
    spark = session(docs)
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(idf)  # SKETCH_ROWS tables of 2 ** TABLE_BITS entries
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles, tf, off = bags(batch.column(1), words)
            n = np.diff(off)
            each = tf * shared.value(shingles)
            drawn = np.zeros((batch.num_rows, BANDS * ROWS), np.uint64)
            cuts = [0]
            while cuts[-1] < len(n):  # some 200,000 shingles at a time stay in the processor's cache
                cuts.append(max(cuts[-1] + 1, int(np.searchsorted(off, off[cuts[-1]] + 200_000, "right")) - 1))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                s = slice(off[lo], off[hi])
                drawn[lo:hi] = samples(shingles[s], each[s], off[lo : hi + 1] - off[lo], BANDS * ROWS)
            bands = np.zeros((batch.num_rows, BANDS), np.uint64)
            for i in range(ROWS):
                bands = mix(bands + drawn[:, i::ROWS])
            bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
            raw = [batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)]
            keys = []
            for i in (1, 2):
                per = np.concatenate([[0], np.cumsum(mix(mix(shingles + np.uint64(i)) + tf.astype(np.uint64)))]).astype(np.uint64)
                keys.append(np.where(n > 0, mix(per[off[1:]] - per[off[:-1]] + n.astype(np.uint64)).view(np.int64), raw[i - 1]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]), pa.int32()), pa.array(bands[n > 0].ravel().view(np.int64)))
            weight = np.bincount(np.repeat(np.arange(len(n)), n), each, len(n)).astype(np.float64)  # of nothing, bincount gives integers
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys[0]), pa.array(keys[1]), lists, pa.array(weight)], ["id", "k1", "k2", "bands", "weight"])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = core(docs, id_col, text_col).withColumns({"_r1": F.xxhash64(F.lit("raw"), text), "_r2": F.xxhash64(F.lit("row"), text)})
    return rows.mapInArrow(run, f"id {id_type}, k1 long, k2 long, bands array<long>, weight double")


# Verification


def similarities(left: pa.Array, right: pa.Array, idf: Weights, words: int = WORDS) -> np.ndarray:
    """Exact weighted Jaccard similarity of paired texts; 0 if neither has a word."""
    sides = [bags(x, words) for x in (left, right)]
    pair = np.concatenate([np.repeat(np.arange(len(o) - 1), np.diff(o)) for _, _, o in sides])
    shingles, tf = np.concatenate([s for s, _, _ in sides]), np.concatenate([t for _, t, _ in sides])
    weight = idf(shingles).astype(np.float64)
    total = np.bincount(pair, weight * tf, len(left))
    key = shingles + mix(np.arange(1, len(left) + 1, dtype=np.uint64))[pair]
    order = np.argsort(key)
    at = np.flatnonzero(key[order][1:] == key[order][:-1])
    one, two = order[at], order[at + 1]
    common = np.bincount(pair[one], weight[one] * np.minimum(tf[one], tf[two]), len(left))
    return np.divide(common, total - common, out=np.zeros(len(left)), where=total > 0)


def compared(pairs: DataFrame, texts: DataFrame, idf: Weights, words: int = WORDS) -> DataFrame:
    """The pairs (a, b) with the similarity of their whole texts."""
    shared = session(pairs).sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(similarities(batch.column(2), batch.column(3), shared.value, words))], ["a", "b", "sim"])

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    kind = pairs.schema["a"].dataType.simpleString()
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}, sim double")


def weighed(nodes: DataFrame, texts: DataFrame, idf: Weights, words: int = WORDS) -> DataFrame:
    """(shingle, node, w): each distinct shingle of these texts and its weight there."""
    shared = session(texts).sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shingles, tf, off = bags(batch.column(1), words)
            weight = tf * shared.value(shingles)
            node = np.repeat(np.arange(batch.num_rows), np.diff(off))
            for lo in range(0, len(shingles), 200_000):
                part = slice(lo, lo + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(shingles[part].view(np.int64)), batch.column(0).take(pa.array(node[part])), pa.array(weight[part].astype(np.float32))], ["shingle", "node", "w"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.join(nodes, F.col("id") == F.col("node"), "left_semi").select("id", "text").mapInArrow(run, f"shingle long, node {kind}, w float")


def unshared(nodes: DataFrame, texts: DataFrame, idf: Weights, words: int = WORDS) -> DataFrame:
    """(node, unshared): the weight of shingles that no other of these texts holds."""
    rows = weighed(nodes, texts, idf, words)
    alone = rows.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("last"), F.max("w").alias("w")).where("node = last")
    return alone.groupBy("node").agg(F.sum(F.col("w").cast("double")).alias("unshared"))


def alike(able: DataFrame, texts: DataFrame, idf: Weights, similarity: float, words: int = WORDS) -> DataFrame:
    """Pairs (a, b) of nodes of different components, none of the wanted similarity left out.

    `able` has node, comp and weight (of several texts the least). Shingles are ordered by the number
    of these texts that hold them, rarest first; what two texts have in common weighs no more than the
    rest of either from their first common shingle on. So they share a shingle whose rest is heavy
    enough in both. Shingles of a single text are in no pair.
    """
    slack = 1e-5  # weights are summed as 32-bit floats
    rows = written(weighed(able.select("node"), texts, idf, words).groupBy("shingle", "node").agg(F.max("w").alias("w")), "weighed")
    held = rows.groupBy("shingle").agg(F.count("*").alias("held"))
    common_first = Window.partitionBy("node").orderBy(F.desc("held"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.join(held, "shingle").where("held > 1").withColumn("rest", F.sum(F.col("w").cast("double")).over(common_first))
    starts = ranked.join(able, "node").where(F.col("rest") >= (similarity - slack) * F.col("weight"))
    starts = written(starts.select("shingle", "node", "comp", "weight", "rest"), "starts")
    one, two = (starts.select("shingle", *[F.col(c).alias(f"{c}{k}") for c in ("node", "comp", "weight", "rest")]) for k in (1, 2))
    enough = F.least("rest1", "rest2") >= (similarity / (1 + similarity) - slack) * (F.col("weight1") + F.col("weight2"))
    both = one.join(two, "shingle").where((F.col("node1") < F.col("node2")) & (F.col("comp1") != F.col("comp2")) & enough)
    out = written(both.select(F.col("node1").alias("a"), F.col("node2").alias("b")).distinct(), "alike")
    dropped(rows)
    dropped(starts)
    return out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each distinct non-null id: id_col and class_id, the smallest id of its class.

    A class is a connected component of links between texts of at least this weighted Jaccard
    similarity; texts with the same bag of shingles are one node, so copies are never expanded into
    pairs. A band's bucket is resolved without all pairs: members are compared with its smallest
    one; where a bucket still holds several components, every member is compared with the smallest
    member of each other component in it; and of what is then still apart, all pairs are compared
    but those that an exact bound excludes, so that no link between texts of one bucket is missed.

    Words are runs of letters, digits and non-ASCII characters in lower case; a text of 1 to
    words - 1 words is one shingle. Texts without words, null and empty ones among them, match only
    equal texts. Rows that share an id are one document. Rows with a null id take no part.
    """
    spark = session(docs)
    rows = core(docs, id_col, text_col).where(F.col(f"`{id_col}`").isNotNull())
    idf = Weights(*frequencies(rows, text_col, words))
    signed = written(signatures(rows, idf, id_col, text_col, words), "signatures")
    nodes = written(signed.groupBy("k1", "k2").agg(F.min("id").alias("node"), F.first("bands").alias("bands"), F.first("weight").alias("weight")), "nodes")
    buckets = nodes.select(F.col("node"), F.explode("bands").alias("bucket")).distinct()
    leaders = buckets.groupBy("bucket").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").select("bucket", "lead")
    members = written(buckets.join(leaders, "bucket"), "members")
    # texts that share a bucket with another: fetched once, so that the comparisons shuffle no others
    some = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where(F.length("text") > 0)
    texts = written(some.join(members.select("node").distinct(), F.col("id") == F.col("node"), "left_semi"), "texts")
    first = members.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    tried = written(compared(first, texts, idf, words), "tried")
    # rows that share an id link its nodes
    shared_id = signed.join(nodes, ["k1", "k2"]).where("id <> node").select(F.col("node").alias("a"), F.col("id").alias("b")).join(nodes.select(F.col("node").alias("b")), "b", "left_semi").select("a", "b")
    links = written(tried.where(F.col("sim") >= similarity).select("a", "b").union(shared_id), "links")
    gap = F.when(F.col("node") == F.col("lead"), F.lit(0.0)).otherwise(1 - F.coalesce("sim", F.lit(0.0))).alias("gap")
    measured = tried.groupBy(F.col("a").alias("lead"), F.col("b").alias("node")).agg(F.max("sim").alias("sim"))
    spaced = members.join(measured, ["lead", "node"], "left").select("bucket", "node", gap)
    comps = components(links)
    labelled = spaced.join(comps, "node", "left").select("bucket", "node", "gap", F.coalesce("comp", "node").alias("comp"))
    open_ = labelled.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket")
    left = written(spaced.join(open_, "bucket", "left_semi"), "open")
    own = unshared(left.select("node").distinct(), texts, idf, words)
    weights = nodes.groupBy("node").agg(F.max("weight").alias("weight")).join(own, "node", "left").select("node", "weight", (F.col("weight") - F.coalesce("unshared", F.lit(0.0))).alias("common"))
    # what no other text in question holds can be in no intersection: beyond this share a text has no near duplicate
    able = left.join(weights, "node").where(F.col("common") >= (similarity - 1e-5) * F.col("weight"))
    spaced = written(able.join(able.groupBy("node").agg(F.collect_set("bucket").alias("buckets")), "node"), "spaced")
    dropped(left)
    reach = 1 - similarity + 1e-9
    labelled = spaced.join(comps, "node", "left").select("bucket", "buckets", "node", "gap", "weight", "common", F.col("comp").isNull().alias("single"), F.coalesce("comp", "node").alias("comp"))
    heads = labelled.groupBy("bucket", "comp").agg(F.min(F.struct("node", "gap", "weight", "common", "single")).alias("h")).select(F.col("bucket").alias("_bucket"), F.col("comp").alias("other"), F.col("h.node").alias("head"), *[F.col(f"h.{c}").alias(f"_{c}") for c in ("gap", "weight", "common", "single")])
    unsettled = heads.groupBy("_bucket").agg(F.count("*").alias("n")).where("n > 1").select("_bucket")
    heads = heads.join(unsettled, "_bucket", "left_semi")
    heads = written(heads.join(heads.groupBy("other", "head").agg(F.collect_set("_bucket").alias("_buckets")), ["other", "head"]), "heads")
    # the weighted Jaccard distance is a metric: distances to a third text differ by no more than a pair's own
    near = F.abs(F.col("gap") - F.col("_gap")) <= reach
    both = F.least("common", "_common")
    able = both >= (similarity - 1e-5) * (F.col("weight") + F.col("_weight") - both)
    # each pair once: from the least bucket that would give it, and of two texts without any link from the smaller
    once = (F.col("bucket") == F.array_min(F.array_intersect("buckets", "_buckets"))) & (~(F.col("single") & F.col("_single")) | (F.col("node") < F.col("head")))
    pairs = labelled.join(heads, (F.col("bucket") == F.col("_bucket")) & (F.col("comp") != F.col("other")) & near & able & once).select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()
    fresh = written(pairs.join(tried, ["a", "b"], "left_anti"), "fresh")
    # merged components have the heads of old ones, so that another such round would give no new pair
    more = written(compared(fresh, texts, idf, words).where(F.col("sim") >= similarity).select("a", "b"), "more")
    comps = components(links.union(more))
    # the rest exactly: members of components of a bucket that are still apart, whichever their heads are
    labelled = spaced.join(comps, "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    open_ = labelled.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("bucket")
    least = nodes.groupBy("node").agg(F.min("weight").alias("weight"))
    apart = written(labelled.join(open_, "bucket", "left_semi").select("node", "comp").distinct().join(least, "node"), "apart")
    last = alike(apart, texts, idf, similarity, words).join(tried, ["a", "b"], "left_anti").join(fresh, ["a", "b"], "left_anti")
    found = written(compared(last, texts, idf, words).where(F.col("sim") >= similarity).select("a", "b"), "found")
    if found.limit(1).count():
        comps = components(links.union(more).union(found))
    dropped(members)
    dropped(spaced)
    dropped(texts)
    by_key = signed.select("id", "k1", "k2").distinct().join(nodes.select("k1", "k2", "node"), ["k1", "k2"])
    out = by_key.join(comps, "node", "left").select(F.col("id").alias(id_col), F.coalesce("comp", "node").alias("class_id"))
    return out.groupBy(id_col).agg(F.min("class_id").alias("class_id"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each class its smallest id stays, all columns unchanged.

    Rows that repeat an id are one document, of which the row of least hashes, of the text first, stays;
    rows with a null id stay.
    """
    own, nth = unused(docs, "_lectern_id"), unused(docs, "_lectern_n")
    classes = near_duplicates(docs, similarity, words, id_col, text_col)
    keep = classes.where(F.col(f"`{id_col}`") == F.col("class_id")).select(F.col(f"`{id_col}`").alias(own))
    known = docs.where(F.col(f"`{id_col}`").isNotNull())
    stay = known.join(keep, F.col(f"`{id_col}`") == F.col(own), "left_semi")
    hashed = [F.xxhash64(F.col(f"`{f.name}`")) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    first = Window.partitionBy(F.col(f"`{id_col}`")).orderBy(F.xxhash64(F.col(f"`{text_col}`")), *hashed)
    single = stay.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(nth)
    return single.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
