"""Graphs, vectors, version layers and coverage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.ranking import ranked, ranked_all


# Vectors


def cosine_distance(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.lit(1.0) - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _regular(vector: str, n: int) -> Column:
    """Whether a vector has n components, all there, none so large or small that a sum of squares overflows or vanishes."""
    sizes = F.transform(vector, lambda x: F.abs(x.cast("double")))
    return F.coalesce((F.size(vector) == n) & F.forall(sizes, lambda x: x < 1e100) & F.exists(sizes, lambda x: x > 1e-100), F.lit(False))


def nearest_of_batches(asked: pa.Table, k: int, cells: int = 4_000_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from batches (key, vector) to (qid, key, distance): what may be among the k nearest of each query (qid, vector).

    A product of matrices and the k-th distance so far leave a few rows of each batch; their distances are then summed in
    the order of components, as cosine_distance() does, so they are the same to the last bit. Of equal distances only the k
    smallest keys are handed on.
    """
    def matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
        flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)

    def summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for d in range(x.shape[1]):
            total = total + x[:, d] * y[:, d]
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = asked.column("qid").combine_chunks()
        q = matrix(asked.column("vector"), asked.num_rows)
        q_norm = np.sqrt(summed(q, q))
        bound = np.full(len(q), np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            v, keys = matrix(batch.column(1), batch.num_rows), batch.column(0)
            v_norm = np.sqrt(summed(v, v))
            place = np.argsort(np.array(keys.to_pylist(), dtype=object), kind="stable")
            rank = np.empty(len(v), np.int64)
            rank[place] = np.arange(len(v))
            unit = (v / v_norm[:, None]).T
            step = max(1, cells // len(v))
            for at in range(0, len(q), step):
                far = 1 - (q[at : at + step] / q_norm[at : at + step, None]) @ unit
                if len(v) > k:
                    bound[at : at + step] = np.minimum(bound[at : at + step], np.partition(far, k - 1, 1)[:, k - 1])
                i, j = np.nonzero(far <= bound[at : at + step, None] + 1e-8)
                i += at
                exact = 1.0 - summed(q[i], v[j]) / (v_norm[j] * q_norm[i])
                order = np.lexsort((rank[j], exact, i))
                i, j, exact = i[order], j[order], exact[order]
                start = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (exact[1:] != exact[:-1]))) if len(i) else np.zeros(0, int)
                kept = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i)))) < k
                yield pa.RecordBatch.from_arrays([names.take(pa.array(i[kept])), keys.take(pa.array(j[kept])), pa.array(exact[kept])], ["qid", "key", "distance"])

    return run


def vector_top_k(corpus: DataFrame, queries: DataFrame, k: int = 60, key: str = "key", vector: str = "vector", most: int = 10_000) -> DataFrame:
    """(qid, rank, key, distance): exact nearest rows by cosine distance for a small, checked number of queries.

    Queries above `most` are refused: they would make the broadcast grow; search them in blocks. Null, empty, zero or
    non-finite vectors and those of another length are compared one by one, the others by products of matrices.
    """
    asked = queries.select("qid", "vector").limit(most + 1).toArrow()
    if asked.num_rows > most:
        raise ValueError(f"over {most} query vectors; search them in blocks")
    n = next((len(x) for x in asked.column("vector") if x.is_valid and len(x)), 0)
    rows = corpus.select(F.col(key).alias("key"), F.col(vector).alias("_v"))
    own = queries.select("qid", F.col("vector").alias("_q"))

    def one_by_one(some: DataFrame, wanted: DataFrame) -> DataFrame:
        return some.crossJoin(F.broadcast(wanted)).select("qid", "key", cosine_distance(F.col("_v"), F.col("_q")).alias("distance"))

    kinds = ", ".join(f"{c} {t.dataType.simpleString()}" for c, t in (("qid", queries.schema["qid"]), ("key", rows.schema["key"])))
    fine, odd = own.where(_regular("_q", n)).select("qid", F.col("_q").alias("vector")).toArrow(), own.where(~_regular("_q", n))
    near = one_by_one(rows.where(~_regular("_v", n)), own)
    if fine.num_rows:
        near = near.union(rows.where(_regular("_v", n)).mapInArrow(nearest_of_batches(fine, k), f"{kinds}, distance double"))
    if fine.num_rows < asked.num_rows:
        near = near.union(one_by_one(rows.where(_regular("_v", n)), odd))
    return ranked(near.withColumn("distance", F.round("distance", 9)), ["qid"], [F.col("distance"), F.col("key")], most=k)


def path_keys(rows: DataFrame, path: str, canonical: DataFrame, order: str, by: Sequence[str]) -> DataFrame:
    """(by, rank, key): the papers behind '<SEP>'-joined paths, canonical, each at its first place."""
    parts = rows.select(*by, order, F.posexplode(F.split(F.coalesce(path, F.lit("")), "<SEP>")).alias("_i", "_p")).withColumn("_p", F.regexp_replace(F.trim("_p"), "^paper/", ""))
    found = parts.join(canonical.select(F.col("key").alias("_p"), F.col("canonical").alias("key")), "_p").groupBy(*by, "key").agg(F.min(F.struct(order, "_i")).alias("_at"))
    return ranked(found, by, [F.col("_at")]).drop("_at")


# Property graphs


def undirected(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """edges with a and b, the end points in order."""
    return edges.withColumns({"a": F.least(source, target), "b": F.greatest(source, target)})


def edges_within(edges: DataFrame, nodes: DataFrame, limit: int | None = None) -> DataFrame:
    """Each undirected edge with both ends among the nodes once, in the order of its ends; the limit is by that order too."""
    ids = nodes.select("id").distinct()
    inner = undirected(edges).join(ids, F.col("a") == F.col("id"), "left_semi").join(ids, F.col("b") == F.col("id"), "left_semi").where("a <> b")
    once = inner.groupBy("a", "b").agg(F.max("weight").alias("weight"), F.min("file_path").alias("file_path"))
    return once.orderBy("a", "b").limit(limit) if limit else once


def topology_scores(edges: DataFrame, facets: DataFrame, paths: DataFrame) -> DataFrame:
    """(key, score, rank): per edge one point if its ends are in different facets plus ln(1 + weight), summed per paper.

    facets: (facet, id); paths: (a, b, key). A non-finite weight raises.
    """
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(0.0))
    finite = F.when(F.isnan(weight) | (F.abs(weight) == float("inf")), F.raise_error(F.lit("non-finite edge weight")).cast("double")).otherwise(weight)
    sets = facets.groupBy("id").agg(F.array_sort(F.collect_set("facet")).alias("f"))
    joined = edges.join(sets.select(F.col("id").alias("a"), F.col("f").alias("fa")), "a").join(sets.select(F.col("id").alias("b"), F.col("f").alias("fb")), "b")
    crosses = F.exists("fa", lambda x: F.exists("fb", lambda y: x != y))
    each = joined.select("a", "b", (F.when(crosses, 1.0).otherwise(0.0) + F.log1p(F.greatest(F.lit(0.0), finite))).alias("s")).where("s > 0")
    scores = each.join(paths, ["a", "b"]).groupBy("key").agg(F.round(F.sum("s"), 9).alias("score"))
    return ranked_all(scores, [-F.col("score"), F.col("key")])


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree) over distinct undirected edges; a loop counts once."""
    one = undirected(edges).select("a", "b").distinct()
    return one.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def edge_degrees(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    one = undirected(edges).select("a", "b").distinct()
    return one.join(d.select(F.col("id").alias("a"), F.col("degree").alias("_x")), "a").join(d.select(F.col("id").alias("b"), F.col("degree").alias("_y")), "b").select("a", "b", (F.col("_x") + F.col("_y")).alias("edge_degree"))


def guardrails(nodes: DataFrame, edges: DataFrame, known_types: Sequence[str], key: Column, least: int = 6) -> DataFrame:
    """One row: entities, relations, average and largest degree, shares off-ontology, colliding and isolated, in percent."""
    e = undirected(edges).select("a", "b").distinct()
    d = degrees(edges)
    sizes = nodes.withColumn("_k", key).groupBy("_k").agg(F.count("*").alias("n"))
    collide = sizes.agg(F.coalesce(F.sum(F.when((F.length("_k") >= least) & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("colliding"))
    head = nodes.join(d, "id", "left").agg(F.count("*").alias("entities"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"), F.count_if(~F.col("type").isin(*known_types)).alias("off"), F.count_if(F.col("degree").isNull()).alias("isolated"))
    rel = e.agg(F.count("*").alias("relations"))
    both = head.crossJoin(rel).crossJoin(collide)
    n = F.greatest(F.col("entities"), F.lit(1))
    return both.select("entities", "relations", F.round(2 * F.col("relations") / n, 6).alias("avg_degree"), "max_degree", *[F.round(100 * F.col(c) / n, 6).alias(f"{c}_pct") for c in ("off", "colliding", "isolated")])


def surface_clusters(nodes: DataFrame, key: Column, least: int = 6) -> DataFrame:
    """(key, members): names that share a surface key of `least` characters or more."""
    return nodes.withColumn("_k", key).groupBy("_k").agg(F.sort_array(F.collect_set("id")).alias("members")).where((F.length("_k") >= least) & (F.size("members") > 1)).select(F.col("_k").alias("key"), "members")


def typed_sweep(nodes: DataFrame, edges: DataFrame, key: Column, least: int = 6) -> DataFrame:
    """(key, action, target, type, members): clusters of at most one known type merge into the member of highest degree, ties by name; others defer."""
    d = degrees(edges)
    known = F.when(F.col("type") != "UNKNOWN", F.col("type"))
    groups = nodes.withColumn("_k", key).join(d, "id", "left").groupBy("_k").agg(
        F.sort_array(F.collect_set("id")).alias("members"), F.sort_array(F.collect_set(known)).alias("types"), F.min_by("id", F.struct(-F.coalesce("degree", F.lit(0)), "id")).alias("target")
    )
    big = groups.where((F.length("_k") >= least) & (F.size("members") > 1))
    merge = F.size("types") <= 1
    return big.select(F.col("_k").alias("key"), F.when(merge, "merge").otherwise("defer").alias("action"), F.when(merge, F.col("target")).alias("target"), F.when(merge, F.coalesce(F.get("types", F.lit(0)), F.lit("UNKNOWN"))).alias("type"), "members")


def rewrite_pairs(pairs: DataFrame, merged: DataFrame) -> DataFrame:
    """(doc, pos, a, b) with merged names replaced: loops go, of an undirected pair the first orientation stays. merged: (name, target)."""
    m = merged.select("name", "target")
    out = pairs.join(m.select(F.col("name").alias("a"), F.col("target").alias("_a")), "a", "left").join(m.select(F.col("name").alias("b"), F.col("target").alias("_b")), "b", "left")
    new = out.select("doc", "pos", F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b")
    first = new.groupBy("doc", F.least("a", "b").alias("_x"), F.greatest("a", "b").alias("_y")).agg(F.min(F.struct("pos", "a", "b")).alias("f"))
    return ranked(first.select("doc", "f.*"), ["doc"], [F.col("pos"), F.col("a"), F.col("b")], "new_pos").drop("pos")


def graph_inventory(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts and digests of a graph: nodes by id, each undirected edge once in the orientation seen last (by pos)."""
    from lectern.operators.sync import TASK_ROWS, state_digest

    n = state_digest(nodes, "id", F.to_json(F.struct("id", "type"))).select(F.col("digest").alias("nodes_sha256"), F.coalesce("n_rows", F.lit(0)).alias("n_nodes"))
    parts = -(-edges.count() // TASK_ROWS) or 1
    last = undirected(edges).repartition(parts, "a", "b").groupBy("a", "b").agg(F.max_by(F.struct("source", "target", "weight"), "pos").alias("e")).select(F.concat_ws("\x1f", "a", "b").alias("k"), "e")
    e = state_digest(last, "k", F.to_json("e")).select(F.col("digest").alias("edges_sha256"), F.coalesce("n_rows", F.lit(0)).alias("n_edges"))
    return n.crossJoin(e).withColumn("state", F.when((F.col("n_nodes") == 0) & (F.col("n_edges") == 0), "verified_empty").otherwise("present"))


# Version layers


def visible_rows(rows: DataFrame, tombstones: DataFrame, stack: Sequence[str], role: str, key: str = "id") -> DataFrame:
    """The row of each id in the newest layer of the stack, unless a newer layer buries it; whole rows.

    rows: (workspace, id, ...); tombstones: (namespace, role, output_id). Namespaces outside the stack
    are passed over; a row made again in the layer of its tombstone stays.
    """
    def place(c: str) -> Column:
        return F.array_position(F.array(*map(F.lit, stack)), F.col(c))

    live = rows.withColumn("_rank", place("workspace")).where("_rank > 0")
    rest = [c for c in rows.columns if c != key]
    newest = live.groupBy(key).agg(F.max_by(F.struct(*rest, "_rank"), "_rank").alias("_r")).select(key, "_r.*")
    graves = tombstones.where(F.col("role") == role).withColumn("_grave", place("namespace")).where("_grave > 0").groupBy(F.col("output_id").alias(key)).agg(F.max("_grave").alias("_grave"))
    return newest.join(graves, key, "left").where("_grave IS NULL OR _rank >= _grave").select(*rows.columns)


# Coverage


def role_states(expected: DataFrame, observations: DataFrame, now: Column, max_age: float = 300.0) -> DataFrame:
    """(unit, role, state): the worst state of a role's expected outputs, by the newest observation of each.

    A future observation is unknown, an old one stale; missing is worst, then unknown, stale, present.
    expected: (unit, role, output, required); observations: (output, observed_at, state).
    """
    newest = observations.groupBy("output").agg(F.max_by(F.struct("observed_at", "state"), F.struct("observed_at", "state")).alias("o"))
    age = now.cast("double") - F.col("o.observed_at").cast("double")
    one = F.when(F.col("output").isNull() | F.col("o").isNull(), "unknown").when(age < 0, "unknown").when(age > max_age, "stale").when(F.col("o.state").isin("present", "missing"), F.col("o.state")).otherwise("unknown")
    order = F.array(*map(F.lit, ("missing", "unknown", "stale", "present")))
    states = expected.join(newest, "output", "left").withColumn("_s", one)
    worst = states.groupBy("unit", "role").agg(F.bool_or("required").alias("required"), F.min(F.array_position(order, F.col("_s"))).alias("_w"))
    return worst.select("unit", "role", F.when(~F.col("required"), "not_applicable").otherwise(F.element_at(order, F.col("_w").cast("int"))).alias("state"))


def section_completeness(required: DataFrame, states: DataFrame) -> DataFrame:
    """Per record: required sections, those complete, and whether all of at least one are. required: (record, units)."""
    each = required.select("record", F.explode_outer("units").alias("unit")).join(states, "unit", "left")
    out = each.groupBy("record").agg(F.count("unit").alias("n_required"), F.count_if(F.col("state") == "complete").alias("n_complete"))
    return out.withColumn("complete", (F.col("n_required") > 0) & (F.col("n_required") == F.col("n_complete")))


def entry_coverage(entries: DataFrame, records: DataFrame, levels: Sequence[str] = ("registered", "readable", "indexed")) -> DataFrame:
    """Per pool and in all (pool null): entries and how many reach each level; entries without a record count in the base.

    entries: (pool, entry, match_key); records: (key, levels...).
    """
    both = entries.join(records.select(F.col("key").alias("match_key"), *levels), "match_key", "left")
    return both.rollup("pool").agg(F.count("*").alias("n_entries"), *[F.count_if(F.coalesce(x, F.lit(False))).alias(f"n_{x}") for x in levels])


def difference_reason(matched: Column, registered: Column, readable: Column, indexed: Column) -> Column:
    """The first level an entry misses."""
    return F.when(~F.coalesce(matched, F.lit(False)), "unmatched").when(~F.coalesce(registered, F.lit(False)), "not_registered").when(~F.coalesce(readable, F.lit(False)), "not_readable").when(~F.coalesce(indexed, F.lit(False)), "not_indexed").otherwise("")


def worst_of(states: DataFrame, by: Sequence[str], state: str, order: Sequence[str]) -> DataFrame:
    places = F.array(*map(F.lit, order))
    return states.groupBy(*by).agg(F.element_at(places, F.min(F.array_position(places, F.col(state))).cast("int")).alias("worst"))


def percentile_index(rows: DataFrame, by: Sequence[str], value: str, q: float, nearest: bool = False) -> DataFrame:
    """Per group the sorted value at min(n - 1, int(q n)), or at ceil(q n) - 1: two definitions that differ.

    Null values count as none. Equal values are counted before a group's values meet.
    """
    held = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    n = F.sum("_c").over(Window.partitionBy(*by))
    at = F.greatest(F.lit(0), F.ceil(q * n) - 1) if nearest else F.least(n - 1, F.floor(q * n))
    return held.withColumns({"_upto": upto, "_at": at}).where("_upto > _at AND _upto - _c <= _at").select(*by, F.col(value).alias("percentile"))
