"""Queries of the composed retrieval plans and of the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import ranking as R
from lectern.operators import retrieval as V
from lectern.plans.ranking import _LISTS, lists
from lectern.plans.registry import query


def dealt(source: str, cap: int, kind: str = "BIGINT") -> str:
    """SQL for the fair shares of the lists (qid, list_idx, rank, key) in `source`: CTEs that end in `dealt` (qid, pos, key)."""
    return f""", once AS (SELECT qid, list_idx, key, min(rank) AS r FROM {source} GROUP BY 1, 2, 3), queue AS (SELECT qid, list_idx, list(key ORDER BY r) AS ks FROM once GROUP BY 1, 2), queues AS (SELECT qid, list(ks ORDER BY list_idx) AS qs FROM queue GROUP BY qid),
turn AS (SELECT qid, qs, CAST([] AS {kind}[]) AS given, 0 AS step, 0 AS misses FROM queues UNION ALL
SELECT qid, qs, CASE WHEN c IS NULL THEN given ELSE list_append(given, c) END, step + 1, CASE WHEN c IS NULL THEN misses + 1 ELSE 0 END FROM (SELECT *, list_filter(qs[step % len(qs) + 1], lambda x: NOT list_contains(given, x))[1] AS c FROM turn WHERE len(given) < {cap} AND misses < len(qs))),
dealt AS (SELECT qid, unnest(range(len(g))) AS pos, unnest(g) AS key FROM (SELECT qid, arg_max(given, step) AS g FROM turn GROUP BY qid))"""


_FUSED = ", again AS (SELECT qid, list_idx, key, row_number() OVER (PARTITION BY qid, list_idx ORDER BY rrf DESC, rank) - 1 AS rank FROM lists JOIN fused USING (qid, key))"
_RECURSIVE = _LISTS.replace("WITH best", "WITH RECURSIVE best")


@query(_RECURSIVE + dealt("lists", 50) + " SELECT qid, CAST(pos AS INTEGER) AS pos, key FROM dealt")
def round_robin_shares(t):
    return R.round_robin(lists(t), 50)


@query(_RECURSIVE + _FUSED + dealt("again", 40) + " SELECT qid, CAST(pos AS INTEGER) AS pos, key FROM dealt")
def fair_merges(t):
    return R.fair_merge(lists(t), 40)


# Orders


_ROWS = """WITH r AS (SELECT p_type AS qid, p_partkey AS key, CAST(p_size % 4 AS DOUBLE) AS score, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 2 END AS vouch, CASE WHEN p_partkey % 5 = 0 THEN 0.5 END AS external_rrf, CASE WHEN p_partkey % 7 > 0 THEN CAST(p_partkey % 7 % 3 AS DOUBLE) END AS authority,
CASE WHEN p_partkey % 11 > 2 THEN 1990 + p_partkey % 11 END AS year, CASE WHEN p_partkey % 6 > 0 THEN p_partkey % 6 END AS citation_count FROM part)
"""


def rows(t):
    k = F.col("p_partkey")
    return t("part").select(F.col("p_type").alias("qid"), k.alias("key"), (F.col("p_size") % 4).cast("double").alias("score"), F.when(k % 3 == 0, k % 2).alias("vouch"), F.when(k % 5 == 0, 0.5).alias("external_rrf"), F.when(k % 7 > 0, (k % 7 % 3).cast("double")).alias("authority"), F.when(k % 11 > 2, 1990 + k % 11).alias("year"), F.when(k % 6 > 0, k % 6).alias("citation_count"))


@query(_ROWS + "SELECT qid, key, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, coalesce(vouch, 0) DESC, coalesce(external_rrf, 0) DESC, coalesce(authority, 0) DESC, coalesce(year, 0) DESC, key) - 1 AS INTEGER) AS rank FROM r")
def relevance_orders(t):
    return V.relevance_order(rows(t), ["qid"]).select("qid", "key", "rank")


@query(_ROWS + """SELECT 'recency' AS hint, qid, key, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, coalesce(year, 0) DESC, key) - 1 AS INTEGER) AS rank FROM r
UNION ALL SELECT 'importance', qid, key, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, coalesce(citation_count, 0) DESC, key) - 1 AS INTEGER) FROM r""")
def hinted_orders(t):
    def said(hint, df):
        return df.select(F.lit(hint).alias("hint"), "qid", "key", "rank")

    return said("recency", V.recency_order(rows(t), ["qid"])).unionByName(said("importance", V.importance_order(rows(t), ["qid"])))


@query(_ROWS + "SELECT key, year, citation_count FROM r ORDER BY coalesce(year, 0) DESC, coalesce(citation_count, 0) DESC, key LIMIT 100")
def library_list(t):
    return V.list_order(rows(t), 100).select("key", "year", "citation_count")


@query(_ROWS + """, o AS (SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY key DESC) - 1 AS rank, ['fulltext', 'canon', 'other', 'abstract_only'][1 + key % 4] AS tier FROM r)
SELECT qid, key, tier, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE tier WHEN 'canon' THEN 1 WHEN 'fulltext' THEN 2 WHEN 'abstract_only' THEN 3 ELSE 4 END, rank) - 1 AS INTEGER) AS rank FROM o""")
def tier_sorts(t):
    tier = F.get(F.array(*map(F.lit, ("fulltext", "canon", "other", "abstract_only"))), (F.col("key") % 4).cast("int"))
    ordered = R.ranked(rows(t).withColumn("tier", tier), ["qid"], [F.col("key").desc()])
    return V.tier_sorted(ordered, ["qid"]).select("qid", "key", "tier", "rank")


@query(_ROWS + """, o AS (SELECT qid, key, row_number() OVER (PARTITION BY qid ORDER BY key) - 1 AS old FROM r), s AS (SELECT *, CAST(key * 7919 % 13 AS DOUBLE) AS relevance_score FROM o WHERE old < 10)
SELECT qid, key, relevance_score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance_score DESC, old) - 1 AS rank FROM s) WHERE rank < 8""")
def reranked(t):
    pool = R.ranked(rows(t), ["qid"], [F.col("key")]).withColumns({"query": F.col("qid"), "content": F.col("key")})
    return V.rerank(pool, lambda q, c: (c * 7919 % 13).cast("double"), ["qid"], 10, 8).select("qid", "key", "relevance_score", "rank")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Title ' END || CASE WHEN doc_id % 2 = 0 THEN 'Venue ' ELSE '' END || CASE WHEN text <> '' THEN text[1:2000] || ' ' ELSE '' END || 'A. One B. Two' || CASE WHEN doc_id % 5 > 0 THEN ' 200' || doc_id % 5 ELSE '' END AS body FROM documents""")
def paper_texts(t):
    d = F.col("doc_id")
    body = V.paper_text(F.when(d % 3 != 0, "Title"), F.when(d % 2 == 0, "Venue").otherwise(""), F.col("text"), F.array(F.lit("A. One"), F.lit("B. Two")), F.when(d % 5 > 0, 2000 + d % 5))
    return t("documents").select("doc_id", body.alias("body"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'c:' || repeat('x', 199) || 'y' WHEN o_orderkey % 3 = 1 THEN 'fp:p' || o_custkey END AS chunk, CASE WHEN o_orderkey % 2 = 0 THEN 'e:c' || o_custkey END AS entity, CASE WHEN o_orderkey % 4 < 3 THEN 'r:' || CASE WHEN o_orderkey % 4 < 2 THEN 'a' ELSE '' END || chr(31) || CASE WHEN o_orderkey % 4 <> 1 THEN 'b' ELSE '' END END AS relation FROM orders""")
def item_keys(t):
    o, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    content = F.when(o % 3 == 0, F.concat(F.lit("x" * 199), F.lit("y"), c)).when(o % 3 == 1, "")
    chunk = V.chunk_key(content, F.when(o % 3 < 2, F.concat(F.lit("p"), c)))
    return t("orders").select("o_orderkey", chunk.alias("chunk"), V.entity_key(F.when(o % 2 == 0, F.concat(F.lit(" c"), c)).otherwise(" ")).alias("entity"), V.relation_key(F.when(o % 4 < 2, "a").otherwise(""), F.when((o % 4 == 0) | (o % 4 == 2), "b")).alias("relation"))


# Local search


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS idx, e FROM v WHERE vec_id % 1000 IN (3, 503) OR vec_id IN (1, 2)),
d AS (SELECT q.idx, v.vec_id, round(1 - list_sum(list_transform(list_zip(q.e, v.e), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(q.e, lambda x: x * x))) * sqrt(list_sum(list_transform(v.e, lambda x: x * x)))), 9) AS dist FROM q, v),
n AS (SELECT idx, vec_id, row_number() OVER (PARTITION BY idx ORDER BY dist, vec_id) - 1 AS rank FROM d), p AS (SELECT idx, vec_id % 97 AS key, min(rank) AS seen FROM n WHERE rank < 60 GROUP BY 1, 2),
l AS (SELECT idx, key, row_number() OVER (PARTITION BY idx ORDER BY seen, key) - 1 AS rank FROM p), e AS (SELECT key, rank FROM l UNION ALL SELECT key, rank FROM l WHERE idx = 0 UNION ALL SELECT key % 97, rank FROM (SELECT p_partkey AS key, p_size AS rank FROM part WHERE p_partkey <= 97)),
f AS (SELECT key, round(sum(1.0 / (60 + rank)), 12) AS rrf FROM e GROUP BY key)
SELECT CAST(row_number() OVER (ORDER BY rrf DESC, key) - 1 AS INTEGER) AS rank, key, round(rrf, 9) AS rrf FROM f""")
def local_search(t):
    v = t("embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    asked = R.ranked(v.where("key % 1000 IN (3, 503) OR key IN (1, 2)").withColumn("g", F.lit(0)), ["g"], [F.col("key")], "idx").select("idx", "vector")
    paper = v.select("key", (F.col("key") % 97).alias("paper"))
    topology = t("part").where("p_partkey <= 97").select((F.col("p_partkey") % 97).alias("key"), F.col("p_size").alias("rank"))
    every = [V.vector_lists(v, asked, paper, False, 0), V.vector_lists(v, asked, paper, True, 9), topology]
    return V.hybrid_local_search(every).select("rank", "key", F.round("rrf", 9).alias("rrf"))


# Answers


def _labelled(t):
    k = F.col("key")
    return lists(t).select("qid", "list_idx", "rank", "key", F.concat(F.lit("p"), (k % 40).cast("string")).alias("paper"), F.get(F.array(*map(F.lit, V.TIERS)), (k % 3).cast("int")).alias("tier"))


def _anchors(t):
    return t("orders").sparkSession.createDataFrame([("F", "strong", 9), ("O", "weak", 9), ("P", "thin", 0)], "qid string, band string, sources int")


_ANSWER = _LISTS + """, place AS (SELECT qid, key, min(list_idx * 1000000 + rank) AS place FROM lists GROUP BY qid, key),
tiered AS (SELECT qid, key, 'p' || key % 40 AS paper, key % 3 AS tier, row_number() OVER (PARTITION BY qid ORDER BY key % 3, rrf DESC, place) - 1 AS r FROM place JOIN fused USING (qid, key)),
capped AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY r) - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, paper ORDER BY r) AS nth FROM tiered) WHERE nth <= 2),
served AS (SELECT qid, rank, key, paper, ['canon', 'fulltext', 'abstract_only'][1 + tier] AS tier, true AS fused FROM capped WHERE qid <> 'O' AND rank < CASE qid WHEN 'F' THEN 63 ELSE 60 END
UNION ALL SELECT qid, rank, key, 'p' || key % 40, ['canon', 'fulltext', 'abstract_only'][1 + key % 3], false FROM lists WHERE qid = 'O' AND list_idx = 0)
"""


_ALONE = _LISTS + """, f AS (SELECT qid, key, key % 3 AS tier, row_number() OVER (PARTITION BY qid ORDER BY key % 3, rank) - 1 AS r FROM lists WHERE list_idx = 0 AND qid = 'F'),
c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY r) - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid, key % 40 ORDER BY r) AS nth FROM f) WHERE nth <= 2)
SELECT qid, CAST(rank AS INTEGER) AS rank, key, 'p' || key % 40 AS paper, ['canon', 'fulltext', 'abstract_only'][1 + tier] AS tier, true AS fused FROM c WHERE rank < 63
UNION ALL SELECT qid, CAST(rank AS INTEGER), key, 'p' || key % 40, ['canon', 'fulltext', 'abstract_only'][1 + key % 3], false FROM lists WHERE qid <> 'F' AND list_idx = 0"""


@query(_ANSWER + "SELECT qid, CAST(rank AS INTEGER) AS rank, key, paper, tier, fused FROM served")
def fused_answers(t):
    return V.fused_retrieval(_labelled(t), _anchors(t), 2)


# The facets of one question found nothing, those of another were never asked for: the first is fused all the same.
@query(_ALONE)
def answers_by_facets(t):
    alone = _labelled(t).where("list_idx = 0")
    return V.fused_retrieval(alone, _anchors(t).withColumn("facets", F.when(F.col("qid") == "F", 3).otherwise(0)), 2)


@query(_ANSWER + "SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY first) - 1 AS INTEGER) AS pos, paper, tier FROM (SELECT qid, paper, min(rank) AS first, arg_min(tier, rank) AS tier FROM served GROUP BY 1, 2)")
def answer_references(t):
    return V.references(V.fused_retrieval(_labelled(t), _anchors(t), 2))


@query(_RECURSIVE + _FUSED + dealt("again", 60) + """, spent AS (SELECT qid, pos, key, 100 + key % 2000 AS tokens, sum(100 + key % 2000) OVER (PARTITION BY qid ORDER BY pos) AS s FROM dealt)
SELECT qid, CAST(pos AS INTEGER) AS pos, key, tokens FROM spent WHERE pos = 0 OR s <= 40000""")
def standard_answers(t):
    sizes = t("customer").select(F.col("c_custkey").alias("key"), (100 + F.col("c_custkey") % 2000).alias("tokens"))
    return V.standard_retrieval(lists(t), sizes, 60, 40_000)


# Pools


_POOL = """WITH RECURSIVE lib AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 10 = 3 THEN p_partkey - 1 WHEN p_partkey % 50 IN (7, 17) THEN NULL ELSE p_partkey END AS canonical, 'i' || CASE WHEN p_partkey % 20 = 4 THEN p_partkey - 4 ELSE p_partkey END AS identity, p_partkey % 2 = 0 AS identified, p_partkey % 13 = 0 AS excluded,
CASE WHEN p_partkey % 9 > 0 THEN 1990 + p_partkey % 30 END AS year, CAST(p_partkey % 37 AS DOUBLE) AS authority, p_partkey % 41 AS citation_count, p_name AS text FROM part),
named AS (SELECT a.key, a.identity AS own, c.key AS canonical, c.identity, c.identified, c.excluded FROM lib a JOIN lib c ON c.key = a.canonical),
gone AS (SELECT own AS identity FROM named WHERE excluded UNION SELECT identity FROM named WHERE excluded),
head AS (SELECT identity, arg_min(canonical, (NOT identified, key)) AS served FROM named WHERE NOT excluded GROUP BY identity),
folds AS (SELECT DISTINCT key, served, own, named.identity FROM named JOIN head USING (identity) WHERE NOT excluded),
alias AS (SELECT identity, min(served) AS served FROM (SELECT own AS identity, served FROM folds UNION SELECT identity, served FROM folds) GROUP BY identity),
corpus AS (SELECT * FROM lib WHERE key IN (SELECT served FROM head) AND (year IS NULL OR year >= 1995)),
ext AS (SELECT o_orderkey % 2 AS term_idx, o_orderkey % 50 AS rank, CASE WHEN o_orderkey % 3 = 0 THEN 'x' || o_custkey ELSE 'i' || o_custkey END AS identity FROM orders),
hits AS (SELECT e.*, served FROM ext e LEFT JOIN alias USING (identity) WHERE e.identity NOT IN (SELECT identity FROM gone)),
lists AS (SELECT 0 AS qid, term_idx AS list_idx, identity AS key, row_number() OVER (PARTITION BY term_idx ORDER BY min(rank), identity) - 1 AS rank FROM hits WHERE served IS NULL GROUP BY term_idx, identity),
fused AS (SELECT qid, key, round(sum(1.0 / (60 + rank)), 12) AS rrf FROM lists GROUP BY qid, key)
"""
_POOL_LIBRARY = """, words AS (SELECT key, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM corpus), size AS (SELECT count(*) AS total, avg(len(w)) AS mean_length FROM words), df AS (SELECT word, count(*) AS n FROM (SELECT key, unnest(list_distinct(w)) AS word FROM words) GROUP BY word),
idf AS (SELECT word, ln((total - n + 0.5) / (n + 0.5)) AS idf FROM df, size), mean AS (SELECT avg(idf) AS m FROM idf), asked AS (SELECT * FROM (VALUES (0, 'red', 1), (0, 'ring', 1), (1, 'small', 1)) AS t(term_idx, word, times)),
want AS (SELECT term_idx, word, times, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM asked JOIN idf USING (word), mean), tf AS (SELECT key, length, word, count(*) AS tf FROM (SELECT key, len(w) AS length, unnest(w) AS word FROM words) GROUP BY 1, 2, 3),
scored AS (SELECT term_idx, key, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length))) AS score FROM tf JOIN want USING (word), size GROUP BY 1, 2),
near AS (SELECT served AS key, min(s_suppkey) AS seen FROM supplier JOIN folds ON folds.key = s_suppkey * 3 GROUP BY 1),
own AS (SELECT term_idx AS list_idx, key, row_number() OVER (PARTITION BY term_idx ORDER BY round(score, 9) DESC, key) - 1 AS rank FROM scored WHERE score > 0 UNION ALL SELECT 2, key, row_number() OVER (ORDER BY seen, key) - 1 FROM near WHERE key IN (SELECT key FROM corpus)),
score AS (SELECT key, round(sum(1.0 / (60 + rank)), 12) AS rrf, min(rank) AS best FROM own GROUP BY key), placed AS (SELECT key, row_number() OVER (ORDER BY authority DESC, rrf DESC, key) - 1 AS place FROM score JOIN corpus USING (key) WHERE best < 800),
total AS (SELECT key, round(rrf + coalesce(4 * 0.25 * (SELECT count(DISTINCT list_idx) FROM own) / (60 + place), 0), 12) AS s FROM score LEFT JOIN placed USING (key)),
again AS (SELECT 0 AS qid, list_idx, key, row_number() OVER (PARTITION BY list_idx ORDER BY s DESC, rank) - 1 AS rank FROM own JOIN total USING (key))"""
_POOL_VOUCHED = """, vouch AS (SELECT served AS key, count(*) AS vouch, round(sum(1.0 / (60 + rank)), 12) AS ext FROM hits WHERE served IS NOT NULL GROUP BY 1),
free AS (SELECT v.*, authority, coalesce(year, 0) AS year FROM vouch v JOIN corpus USING (key) WHERE key NOT IN (SELECT key FROM dealt)), ranked AS (SELECT *, row_number() OVER (ORDER BY authority DESC, ext DESC, vouch DESC, year DESC, key) - 1 AS a FROM free),
also AS (SELECT key, row_number() OVER (ORDER BY round(ext + 2.0 * 0.25 / (60 + a), 12) DESC, vouch DESC, authority DESC, year DESC, key) - 1 AS pos FROM ranked)
SELECT 'library' AS arm, CAST(pos AS INTEGER) AS pos, CAST(key AS VARCHAR) AS key FROM dealt UNION ALL SELECT 'vouched', CAST(pos AS INTEGER), CAST(key AS VARCHAR) FROM also WHERE pos < 45"""


def _pool(t):
    k, o = F.col("p_partkey"), F.col("o_orderkey")
    alias = F.when(k % 10 == 3, k - 1).when(k % 50 == 7, k).when(k % 50 == 17, F.lit(-1))
    identity = F.concat(F.lit("i"), F.when(k % 20 == 4, k - 4).otherwise(k).cast("string"))
    library = t("part").select(k.alias("key"), alias.alias("alias_key"), identity.alias("identity"), (k % 2 == 0).alias("identified"), (k % 13 == 0).alias("excluded"), F.when(k % 9 > 0, 1990 + k % 30).alias("year"), (k % 37).cast("double").alias("authority"), (k % 41).alias("citation_count"), F.col("p_name").alias("text"))
    terms = library.sparkSession.createDataFrame([(0, "red ring"), (1, "small")], "term_idx int, term string")
    kg = t("supplier").select(F.col("s_suppkey").alias("rank"), (F.col("s_suppkey") * 3).alias("key"))
    external = t("orders").select((o % 2).cast("int").alias("term_idx"), (o % 50).alias("rank"), F.concat(F.when(o % 3 == 0, "x").otherwise("i"), F.col("o_custkey").cast("string")).alias("identity"))
    return V.pool_fusion(library, terms, kg, external, first_year=1995)


@query(_POOL + _POOL_LIBRARY + dealt("again", 45) + _POOL_VOUCHED)
def library_pools(t):
    return _pool(t).where("arm <> 'external'")


@query(_POOL + _FUSED + dealt("again", 60, "VARCHAR") + " SELECT 'external' AS arm, CAST(pos AS INTEGER) AS pos, key FROM dealt")
def external_pools(t):
    return _pool(t).where("arm = 'external'")


@query(_LISTS.replace("WITH best", "WITH RECURSIVE best") + _FUSED + dealt("again", 40) + " SELECT qid, CAST(pos AS INTEGER) AS pos, key FROM dealt")
def graph_parts(t):
    return V.graph_part(lists(t))

