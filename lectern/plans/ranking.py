"""Queries of the retrieval, fusion, vector and graph families."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import graphs as G
from lectern.operators import ranking as R
from lectern.plans.registry import query

TERMS = ["the and of", "les tion entre", "und der die"]

_BM25 = """WITH words AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
size AS (SELECT count(*) AS total, avg(len(w)) AS mean_length FROM words),
df AS (SELECT word, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(w)) AS word FROM words) GROUP BY word),
idf AS (SELECT word, ln((total - n + 0.5) / (n + 0.5)) AS idf FROM df, size),
mean AS (SELECT avg(idf) AS m FROM idf),
asked AS (SELECT * FROM (VALUES (0, 'the', 1), (0, 'and', 1), (0, 'of', 1), (1, 'les', 1), (1, 'tion', 1), (1, 'entre', 1), (2, 'und', 1), (2, 'der', 1), (2, 'die', 1)) AS t(term_idx, word, times)),
want AS (SELECT term_idx, word, times, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM asked JOIN idf USING (word), mean),
tf AS (SELECT doc_id, length, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS word FROM words) WHERE word IN (SELECT word FROM asked) GROUP BY 1, 2, 3),
scored AS (SELECT term_idx, doc_id AS key, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))) AS score FROM tf JOIN want USING (word), size GROUP BY 1, 2),
ranked AS (SELECT term_idx, row_number() OVER (PARTITION BY term_idx ORDER BY round(score, 9) DESC, key) - 1 AS rank, key, score FROM scored WHERE score > 0)
"""


def bm25_lists(t, most=None):
    queries = t("documents").sparkSession.createDataFrame(list(enumerate(TERMS)), "term_idx int, term string")
    return R.bm25(t("documents"), queries, key="doc_id", most=most)


@query(_BM25 + "SELECT term_idx, CAST(rank AS INTEGER) AS rank, key, round(score, 6) AS score FROM ranked WHERE rank < 100")
def bm25_terms(t):
    return bm25_lists(t, 100).select("term_idx", "rank", "key", F.round("score", 6).alias("score"))


@query(_BM25 + "SELECT key, round(sum(1.0 / (60 + rank)), 9) AS rrf FROM ranked GROUP BY key ORDER BY round(sum(1.0 / (60 + rank)), 12) DESC, key LIMIT 20")
def rrf_search(t):
    fused = R.rrf(bm25_lists(t))
    return fused.orderBy(F.col("rrf").desc(), "key").limit(20).select("key", F.round("rrf", 9).alias("rrf"))


def lists(t):
    """Five rank lists (by order priority) of customers, by order value, for each order status; a customer may stand in many."""
    best = t("orders").groupBy("o_orderstatus", "o_orderpriority", "o_custkey").agg(F.max("o_totalprice").alias("v"), F.min("o_orderkey").alias("item"))
    named = best.select(F.col("o_orderstatus").alias("qid"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("list_idx"), F.col("o_custkey").alias("key"), "v", "item")
    return R.ranked_wide(named, ["qid", "list_idx"], [F.col("v").desc(), F.col("key")]).select("qid", "list_idx", "rank", "key", "item")


_LISTS = """WITH best AS (SELECT o_orderstatus AS qid, CAST(o_orderpriority[1:1] AS INTEGER) - 1 AS list_idx, o_custkey AS key, max(o_totalprice) AS v, min(o_orderkey) AS item FROM orders GROUP BY 1, 2, 3),
lists AS (SELECT qid, list_idx, row_number() OVER (PARTITION BY qid, list_idx ORDER BY v DESC, key) - 1 AS rank, key, item FROM best),
fused AS (SELECT qid, key, round(sum(1.0 / (60 + rank)), 12) AS rrf FROM lists GROUP BY qid, key)
"""


@query(_LISTS + "SELECT qid, key, round(rrf, 9) AS rrf FROM fused")
def rrf_fuse(t):
    return R.rrf(lists(t), ["qid"]).select("qid", "key", F.round("rrf", 9).alias("rrf"))


@query(_LISTS + """, f AS (SELECT qid, key, first(item ORDER BY list_idx, rank) AS item, min(list_idx * 1000000 + rank) AS place FROM lists GROUP BY qid, key)
SELECT qid, key, round(rrf, 9) AS rrf, item, CAST(row_number() OVER (PARTITION BY qid ORDER BY rrf DESC, place) - 1 AS INTEGER) AS fused_rank FROM f JOIN fused USING (qid, key)""")
def rrf_representatives(t):
    return R.rrf_representative(lists(t), ["item"], ["qid"]).select("qid", "key", F.round("rrf", 9).alias("rrf"), "item", "fused_rank")


@query(_LISTS + """SELECT qid, list_idx, key, CAST(row_number() OVER (PARTITION BY qid, list_idx ORDER BY rrf DESC, rank) - 1 AS INTEGER) AS rank FROM lists JOIN fused USING (qid, key)""")
def rrf_reordered(t):
    return R.rrf_reorder(lists(t), ["qid"]).select("qid", "list_idx", "key", "rank")


@query(_LISTS + """, once AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY list_idx, rank) - 1 AS pos FROM lists),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY pos) AS nth FROM once) WHERE nth <= 2)
SELECT * FROM (SELECT qid, key, CAST(row_number() OVER (PARTITION BY qid ORDER BY pos) - 1 AS INTEGER) AS pos FROM kept) WHERE pos < 300""")
def paper_caps(t):
    rows = R.ranked(lists(t), ["qid"], [F.col("list_idx"), F.col("rank")], "pos")
    return R.per_key_cap(rows, 2, 300, ["qid"], "key", "pos").select("qid", "key", "pos")


@query(_LISTS + """, once AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY list_idx, rank) - 1 AS pos FROM lists),
f AS (SELECT qid, key, min(pos) AS first_pos FROM once GROUP BY qid, key)
SELECT * FROM (SELECT qid, key, CAST(first_pos AS INTEGER) AS first_pos, CAST(row_number() OVER (PARTITION BY qid ORDER BY first_pos) - 1 AS INTEGER) AS pos FROM f) WHERE pos < 12""")
def distinct_heads(t):
    rows = R.ranked(lists(t), ["qid"], [F.col("list_idx"), F.col("rank")], "first_pos")
    return R.first_distinct(rows, 12, ["qid"], "key", "first_pos").select("qid", "key", "first_pos", "pos")


@query("""SELECT lang, doc_id, tokens FROM (SELECT lang, doc_id, (length(text) + 3) // 4 AS tokens, sum((length(text) + 3) // 4) OVER w AS spent, row_number() OVER w AS nth FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id))
WHERE nth = 1 OR spent <= 130000""")
def token_budgets(t):
    from lectern.functions.text import token_estimate

    rows = t("documents").select("lang", "doc_id", token_estimate(F.col("text")).alias("tokens"))
    return R.token_budget(rows, 130_000, ["lang"], F.col("tokens"), "doc_id")


@query("""SELECT term_idx, backend, key FROM (SELECT o_custkey % 7 AS term_idx, o_orderpriority AS backend, o_orderkey AS key, row_number() OVER (PARTITION BY o_custkey % 7, o_orderpriority ORDER BY o_orderkey) AS nth FROM orders)
WHERE nth <= CASE WHEN backend IN ('1-URGENT', '2-HIGH') THEN 30 ELSE 15 END""")
def fetch_caps(t):
    rows = t("orders").select((F.col("o_custkey") % 7).alias("term_idx"), F.col("o_orderpriority").alias("backend"), F.col("o_orderkey").alias("key"))
    return R.fetch_cap(rows, {"1-URGENT": 30, "2-HIGH": 30}, 15, rank="key")


_PARTS = """WITH rows AS (SELECT p_type AS qid, p_partkey AS key, CAST(p_size // 5 AS DOUBLE) / 10 AS score, row_number() OVER (PARTITION BY p_type ORDER BY p_size // 5 DESC, p_partkey) - 1 AS rank,
CASE WHEN p_partkey % 30 > 0 THEN CAST(p_partkey % 97 AS DOUBLE) / greatest(1, 2024 - (1995 + p_partkey % 30)) ELSE CAST(p_partkey % 97 AS DOUBLE) END * CASE WHEN p_partkey % 5 = 0 THEN 1.5 ELSE 1.0 END AS authority FROM part)
"""


def parts(t):
    k = F.col("p_partkey")
    year = F.when(k % 30 > 0, 1995 + k % 30)
    rows = t("part").select(F.col("p_type").alias("qid"), k.alias("key"), (F.floor(F.col("p_size") / 5).cast("double") / 10).alias("score"), R.authority_value(k % 97, year, F.when(k % 5 == 0, 1.5).otherwise(1.0), 2024).alias("authority"))
    return R.ranked(rows, ["qid"], [F.col("score").desc(), F.col("key")])


@query(_PARTS + """, d AS (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY score DESC) - 1 AS dense, row_number() OVER (PARTITION BY qid ORDER BY authority DESC, rank) - 1 AS auth FROM rows)
SELECT qid, key, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(1.0 / (60 + dense) + 0.25 / (60 + auth), 12) DESC, rank) - 1 AS INTEGER) AS rank FROM d""")
def authority_order(t):
    return R.authority_reorder(parts(t), ["qid"]).select("qid", "key", "rank")


@query(_PARTS + """, c AS (SELECT rows.*, CASE WHEN key % 3 <> 0 THEN key % 97 END AS citations FROM rows),
r AS (SELECT *, CASE WHEN citations IS NULL THEN count(*) OVER (PARTITION BY qid) ELSE rank() OVER (PARTITION BY qid ORDER BY citations DESC NULLS LAST) - 1 END AS cite FROM c)
SELECT qid, key, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(1.0 / (60 + rank) + 0.5 / (60 + cite), 12) DESC, rank) - 1 AS INTEGER) AS new_rank FROM r""")
def citation_priors(t):
    k = F.col("p_partkey")
    counts = t("part").where(k % 3 != 0).select(k.alias("key"), (k % 97).alias("citations"))
    return R.citation_prior(parts(t), ["qid"], "key", counts, 0.5).select("qid", "key", "new_rank")


@query("""WITH c AS (SELECT p_partkey AS key, 1.0 / (60 + p_partkey % 900) AS rrf, p_partkey % 900 AS best_rank, CAST(p_partkey % 37 AS DOUBLE) AS authority FROM part),
p AS (SELECT key, row_number() OVER (ORDER BY authority DESC, rrf DESC, key) - 1 AS place FROM c WHERE best_rank < 800)
SELECT key, round(rrf + coalesce(4 * 0.25 * 3 / (60 + place), 0), 9) AS fused FROM c LEFT JOIN p USING (key)""")
def authority_bonus(t):
    k = F.col("p_partkey")
    rows = t("part").select(k.alias("key"), (1 / (60 + k % 900)).alias("rrf"), (k % 900).alias("best_rank"), (k % 37).cast("double").alias("authority"))
    return R.pool_bonus(rows, 3).select("key", F.round("fused", 9).alias("fused"))


@query("""SELECT p_partkey AS key, CASE WHEN p_size % 10 = 9 THEN 1.0 ELSE p_size / 40.0 END AS score FROM part WHERE p_partkey % 2 = 0 AND (p_size % 10 = 9 OR p_size % 10 <> 8 AND p_size / 40.0 >= 0.4 AND p_size / 40.0 <= 1.0)
UNION ALL SELECT p_partkey, 1.0 FROM part WHERE p_partkey % 2 = 0 AND p_size % 10 NOT IN (8, 9) AND p_size / 40.0 > 1.0""")
def gated(t):
    s = F.col("p_size")
    scores = t("part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), F.when(s % 10 == 9, 7.5).when(s % 10 == 8, float("nan")).otherwise(s / 40.0).alias("score"))
    return R.gate(t("part").select(F.col("p_partkey").alias("key")), scores).select("key", "score")


@query(_PARTS.replace("WITH rows", "WITH RECURSIVE rows") + """, w AS (SELECT qid, CAST(1 + key % 15 AS BIGINT) AS mask, min(rank) AS i FROM rows WHERE key % 3 = 0 GROUP BY 1, 2),
s AS (SELECT DISTINCT qid, CAST(0 AS BIGINT) AS have, 0 AS n, 0 AS moved, CAST(0 AS BIGINT) AS total, CAST([] AS BIGINT[]) AS ids, CAST(-1 AS BIGINT) AS top FROM rows
UNION ALL SELECT s.qid, have | mask, n + 1, moved + CAST(i >= 3 AS INTEGER), total + i, list_append(ids, i), i FROM s JOIN w ON w.qid = s.qid AND i > top WHERE n < 3),
b AS (SELECT qid, ids FROM (SELECT qid, ids, row_number() OVER (PARTITION BY qid ORDER BY have & 1 DESC, have & 2 DESC, have & 4 DESC, have & 8 DESC, moved, n, total, ids) AS r FROM s) WHERE r = 1),
m AS (SELECT rows.qid, key, rank, len(ids) AS taken, list_contains(ids, rank) AS w FROM rows JOIN b ON b.qid = rows.qid),
f AS (SELECT *, row_number() OVER (PARTITION BY qid, w ORDER BY rank) AS nth FROM m)
SELECT qid, key, CAST(row_number() OVER (PARTITION BY qid ORDER BY w OR nth <= 3 - taken DESC, rank) - 1 AS INTEGER) AS rank FROM f""")
def named_covers(t):
    rows = parts(t).withColumns({"mask": (1 + F.col("key") % 15).cast("int"), "score": F.when(F.col("key") % 3 == 0, 0.9).otherwise(0.3)})
    return R.named_cover(rows, 4, 3)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 OR c_custkey % 31 < 5 THEN 'empty' WHEN c_custkey % 4 >= c_custkey % 6 THEN 'weak' WHEN c_custkey % 31 < 20 THEN 'thin' ELSE 'strong' END AS band,
greatest(60, least(100, least(30, c_custkey % 40) * 7)) AS budget FROM customer""")
def coverage_bands(t):
    c = F.col("c_custkey")
    chunks = c % 6
    return t("customer").select("c_custkey", R.coverage_band(chunks, F.least(chunks, c % 4), c % 31).alias("band"), R.fan_out(c % 40).alias("budget"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey AS key, round(o_totalprice / 500000, 4) AS confidence, CASE WHEN o_orderkey % 2 = 0 THEN 'llm' ELSE 'keyword' END AS provenance FROM orders),
b AS (SELECT *, row_number() OVER w AS n, lead(confidence) OVER w AS nxt FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY confidence DESC, key))
SELECT o_custkey, CASE WHEN confidence >= CASE WHEN provenance = 'llm' THEN 0.85 ELSE 0.95 END AND (nxt IS NULL OR confidence - nxt >= 0.2) THEN key END AS resolved, confidence FROM b WHERE n = 1""")
def auto_resolved(t):
    o = t("orders")
    rows = o.select("o_custkey", F.col("o_orderkey").alias("key"), F.round(F.col("o_totalprice") / 500000, 4).alias("confidence"), F.when(F.col("o_orderkey") % 2 == 0, "llm").otherwise("keyword").alias("provenance"))
    return R.auto_resolve(rows, ["o_custkey"])


@query("""WITH c AS (SELECT l_orderkey AS qid, l_suppkey AS key, count(*) AS times FROM lineitem GROUP BY 1, 2),
r AS (SELECT l_orderkey AS qid, l_suppkey AS key, min(l_linenumber) AS rank FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2)
SELECT qid, key, times, rank, CAST(row_number() OVER (PARTITION BY qid ORDER BY times DESC, rank, key) - 1 AS INTEGER) AS out_rank FROM c JOIN r USING (qid, key)""")
def outfeeds(t):
    items = t("lineitem")
    answers = items.groupBy(F.col("l_orderkey").alias("qid")).agg(F.collect_list("l_suppkey").alias("cited"))
    served = items.where("l_linenumber <= 4").groupBy(F.col("l_orderkey").alias("qid"), F.col("l_suppkey").alias("key")).agg(F.min("l_linenumber").alias("rank"))
    out = R.citation_outfeed(answers, served, F.col("cited"))
    return R.ranked(out.drop("out_rank"), ["qid"], [F.col("times").desc(), F.col("rank"), F.col("key")], "out_rank")


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (SELECT q.vec_id AS qid, c.vec_id AS key, round(1 - list_sum(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(q.e, lambda x: x * x))) * sqrt(list_sum(list_transform(c.e, lambda x: x * x)))), 9) AS distance FROM v q, v c WHERE q.vec_id % 100 = 0)
SELECT qid, CAST(rank AS INTEGER) AS rank, key, CASE WHEN distance = 0 THEN 0.0 ELSE distance END AS distance FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY distance, key) - 1 AS rank, key, distance FROM d) WHERE rank < 60""")
def vector_search(t):
    e = t("embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    return G.vector_top_k(e, queries, 60, "vec_id", "embedding").select("qid", "rank", "key", "distance")


@query("""WITH p AS (SELECT o_custkey AS qid, o_orderkey AS ord, unnest([0, 1]) AS i, unnest(['p' || o_orderkey % 50, 'p' || o_orderkey % 7]) AS raw FROM orders),
f AS (SELECT qid, 'p' || (CAST(raw[2:] AS INTEGER) // 2 * 2) AS key, min(ord * 10 + i) AS place FROM p GROUP BY 1, 2)
SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY place) - 1 AS INTEGER) AS rank, key FROM f""")
def path_key_lists(t):
    o = F.col("o_orderkey")
    rows = t("orders").select(F.col("o_custkey").alias("qid"), o.alias("ord"), F.concat(F.lit("paper/p"), (o % 50).cast("string"), F.lit("<SEP> p"), (o % 7).cast("string"), F.lit("<SEP>none")).alias("path"))
    canon = t("orders").sparkSession.range(50).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("key"), F.concat(F.lit("p"), (F.floor(F.col("id") / 2) * 2).cast("string")).alias("canonical"))
    return G.path_keys(rows, "path", canon, "ord", ["qid"])


def supply(t):
    """Undirected edges part - supplier as text ids, weight by line count."""
    e = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").cast("double").alias("weight"))
    return e.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("source"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target"), "weight", F.concat(F.lit("f"), (F.col("l_partkey") % 9).cast("string")).alias("file_path"))


_EDGES = "WITH e AS (SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b, count(*) AS weight, 'f' || any_value(l_partkey % 9) AS file_path FROM lineitem GROUP BY l_partkey, l_suppkey)\n"


@query(_EDGES + "SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY id")
def node_degrees(t):
    return G.degrees(supply(t))


@query(_EDGES + ", d AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY id)\nSELECT e.a, e.b, x.degree + y.degree AS edge_degree FROM e JOIN d x ON e.a = x.id JOIN d y ON e.b = y.id")
def edge_degree_sums(t):
    return G.edge_degrees(supply(t))


@query(_EDGES + "SELECT a, b, CAST(weight AS DOUBLE) AS weight, file_path FROM e WHERE CAST(a[2:] AS INTEGER) % 3 <> 0 AND CAST(b[2:] AS INTEGER) % 2 = 0")
def edges_between(t):
    nodes = t("part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id")).union(t("supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))))
    return G.edges_within(supply(t), nodes).select("a", "b", "weight", "file_path")


@query(_EDGES + """, s AS (SELECT file_path AS key, sum(CASE WHEN CAST(a[2:] AS INTEGER) % 2 = 0 OR CAST(b[2:] AS INTEGER) % 2 = 1 THEN 1.0 ELSE 0.0 END + ln(1 + weight)) AS score FROM e GROUP BY file_path)
SELECT key, round(score, 4) AS score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, key) - 1 AS INTEGER) AS rank FROM s""")
def topology(t):
    e = G.undirected(supply(t))
    p = e.select(F.col("a").alias("id")).distinct()
    s = e.select(F.col("b").alias("id")).distinct()
    n = F.substring("id", 2, 20).cast("int")
    facets = p.select(F.lit(0).alias("facet"), "id").union(p.where(n % 2 == 0).select(F.lit(1), "id")).union(s.select(F.lit(0), "id")).union(s.where(n % 2 == 1).select(F.lit(2), "id"))
    return G.topology_scores(e, facets, e.select("a", "b", F.col("file_path").alias("key"))).select("key", F.round("score", 4).alias("score"), "rank")


def names(t, only: bool = False):
    """Part names with numbers, spelled two ways, and their types."""
    k = F.col("p_partkey")
    n = F.floor(k / 2).cast("string")
    name = F.when(k % 2 == 0, F.concat(F.lit("Big-Part"), n)).otherwise(F.concat(F.lit("big part_"), n))
    if only:
        return name
    return t("part").select(name.alias("id"), F.when(F.col("p_size") % 3 == 0, "UNKNOWN").otherwise(F.col("p_type")).alias("type"))


_NAMES = """WITH n AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'Big-Part' || p_partkey // 2 ELSE 'big part_' || p_partkey // 2 END AS id, CASE WHEN p_size % 3 = 0 THEN 'UNKNOWN' ELSE p_type END AS type FROM part),
k AS (SELECT regexp_replace(lower(id), '[\\s_-]+', '', 'g') AS key, id, type FROM n)
"""


@query(_NAMES + "SELECT key, list_sort(list(DISTINCT id)) AS members FROM k GROUP BY key HAVING length(key) >= 6 AND count(DISTINCT id) > 1")
def clusters(t):
    from lectern.functions.text import entity_surface_key

    return G.surface_clusters(names(t), entity_surface_key(F.col("id")))


def trade(t):
    """Edges between parts, by their names, and suppliers."""
    named = t("part").select("p_partkey", names(t, True).alias("source"))
    e = t("lineitem").where("l_partkey % 5 <> 0").join(named, F.col("l_partkey") == F.col("p_partkey"))
    return e.groupBy("source", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target")).agg(F.count("*").cast("double").alias("weight"))


_TRADE = _NAMES + """, b AS (SELECT DISTINCT CASE WHEN l_partkey % 2 = 0 THEN 'Big-Part' || l_partkey // 2 ELSE 'big part_' || l_partkey // 2 END AS a, 's' || l_suppkey AS b FROM lineitem WHERE l_partkey % 5 <> 0), d AS (SELECT a AS id, count(*) AS degree FROM b GROUP BY 1)
"""


@query(_TRADE + """SELECT key, CASE WHEN count(DISTINCT type) FILTER (type <> 'UNKNOWN') <= 1 THEN 'merge' ELSE 'defer' END AS action,
CASE WHEN count(DISTINCT type) FILTER (type <> 'UNKNOWN') <= 1 THEN arg_min(id, (-coalesce(degree, 0), id)) END AS target,
CASE WHEN count(DISTINCT type) FILTER (type <> 'UNKNOWN') <= 1 THEN coalesce(min(type) FILTER (type <> 'UNKNOWN'), 'UNKNOWN') END AS type, list_sort(list(DISTINCT id)) AS members
FROM k LEFT JOIN d USING (id) GROUP BY key HAVING length(key) >= 6 AND count(DISTINCT id) > 1""")
def sweeps(t):
    from lectern.functions.text import entity_surface_key

    return G.typed_sweep(names(t), trade(t), entity_surface_key(F.col("id")))


@query(_TRADE + """, s AS (SELECT key, count(*) AS n FROM k GROUP BY key), c AS (SELECT coalesce(sum(n), 0) AS n FROM s WHERE length(key) >= 6 AND n > 1)
SELECT count(*) AS entities, (SELECT count(*) FROM b) AS relations, round(2 * (SELECT count(*) FROM b) / count(*), 6) AS avg_degree, max(degree) AS max_degree,
round(100.0 * count(*) FILTER (type NOT IN ('ECONOMY', 'STANDARD')) / count(*), 6) AS off_pct, round(100.0 * (SELECT n FROM c) / count(*), 6) AS colliding_pct, round(100.0 * count(*) FILTER (degree IS NULL) / count(*), 6) AS isolated_pct FROM n LEFT JOIN d USING (id)""")
def guardrail_report(t):
    from lectern.functions.text import entity_surface_key

    return G.guardrails(names(t), trade(t), ["ECONOMY", "STANDARD"], entity_surface_key(F.col("id")))


@query("""WITH p AS (SELECT l_orderkey AS doc, l_linenumber AS pos, 'p' || ((l_partkey % 40) // 2) AS a, 'p' || ((l_suppkey % 40) // 2) AS b FROM lineitem),
f AS (SELECT doc, least(a, b) AS x, greatest(a, b) AS y, min(pos) AS pos, first(a ORDER BY pos, a, b) AS a, first(b ORDER BY pos, a, b) AS b FROM p WHERE a <> b GROUP BY 1, 2, 3)
SELECT doc, a, b, CAST(row_number() OVER (PARTITION BY doc ORDER BY pos, a, b) - 1 AS INTEGER) AS new_pos FROM f""")
def rewritten_pairs(t):
    def name(c):
        return F.concat(F.lit("n"), (F.col(c) % 40).cast("string"))

    pairs = t("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos"), name("l_partkey").alias("a"), name("l_suppkey").alias("b"))
    merged = t("lineitem").sparkSession.range(40).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("p"), F.floor(F.col("id") / 2).cast("string")).alias("target"))
    return G.rewrite_pairs(pairs, merged).select("doc", "a", "b", "new_pos")


def _tree(rows: str, levels: int = 5) -> str:
    """SQL for the digest of rows (k, h), k unique: a tree with a level below its root for each 16 times 4096 rows."""
    deep = " + ".join(f"CAST(count(*) > {4096 << 4 * i} AS INTEGER)" for i in range(levels))
    rows = f"SELECT k, h, depth FROM ({rows}), (SELECT {deep} AS depth FROM ({rows}))"
    for d in range(levels, -1, -1):
        rows = f"SELECT CASE WHEN {d} <= depth THEN k[1:{d}] ELSE k END AS k, CASE WHEN {d} <= depth THEN sha256(string_agg(k || '=' || h, chr(10) ORDER BY k || '=' || h)) ELSE any_value(h) END AS h, depth FROM ({rows}) GROUP BY 1, depth"
    return f"SELECT h FROM ({rows})"


@query(_NAMES + f"""SELECT ({_tree("""SELECT sha256(id) AS k, sha256('{"id":"' || id || '","type":"' || type || '"}') AS h FROM n""")}) AS nodes_sha256, (SELECT count(*) FROM n) AS n_nodes,
({_tree("""SELECT sha256('p' || l_partkey || chr(31) || 's' || l_suppkey) AS k, sha256('{"source":"p' || l_partkey || '","target":"s' || l_suppkey || '","weight":' || count(*) || '.0}') AS h FROM lineitem GROUP BY l_partkey, l_suppkey""")}) AS edges_sha256,
(SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)) AS n_edges, 'present' AS state""")
def graph_digests(t):
    e = supply(t).withColumn("pos", F.xxhash64("source", "target"))
    return G.graph_inventory(names(t), e)
