"""Queries of the catalog family."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import catalog as C
from lectern.plans.registry import query


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'doi:10.1000/x' || c_custkey WHEN c_custkey % 4 = 1 THEN 'arxiv:2001.' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') WHEN c_custkey % 4 = 2 THEN 'ads:' || c_custkey ELSE 'sha256:' || sha256('customer ' || c_custkey) END AS identity FROM customer""")
def identities(t):
    c = F.col("c_custkey")
    doi = F.when(c % 4 == 0, F.concat(F.lit("https://doi.org/10.1000/X"), c.cast("string")))
    arxiv = F.when(c % 4 == 1, F.concat(F.lit("arXiv:2001."), F.lpad(c.cast("string"), 5, "0"), F.lit("v1")))
    return t("customer").select("c_custkey", C.candidate_identity(doi, arxiv, F.when(c % 4 == 2, "ADS"), F.concat(F.lit("000"), c.cast("string")), F.concat(F.lit("Customer #"), c.cast("string"))).alias("identity"))


@query("""WITH r AS (SELECT o_custkey % 200 AS k, o_orderkey AS pos, 1.0 / (60 + o_orderkey % 30) AS rrf, o_orderkey % 30 AS rank, CASE WHEN o_orderkey % 3 = 0 THEN ' ' WHEN o_orderkey % 3 = 1 THEN 't' || o_orderkey END AS title FROM orders)
SELECT 'i' || k AS identity, min(pos) AS pos, round(sum(rrf), 9) AS rrf, min(rank) AS rank, count(*) AS n, arg_min(title, pos) FILTER (trim(title) <> '') AS title FROM r GROUP BY k""")
def previews(t):
    o = F.col("o_orderkey")
    rows = t("orders").select((F.col("o_custkey") % 200).alias("k"), o.alias("pos"), (1 / (60 + o % 30)).alias("rrf"), (o % 30).alias("rank"), F.when(o % 3 == 0, " ").when(o % 3 == 1, F.concat(F.lit("t"), o.cast("string"))).alias("title"))
    return C.candidate_preview(rows, F.concat(F.lit("i"), F.col("k").cast("string")), ["title"]).withColumn("rrf", F.round("rrf", 9))


@query("""SELECT c_name AS identity, keys FROM (SELECT CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'n' || c_custkey % 700 END AS c_name, list_sort(list(c_custkey)) AS keys FROM customer GROUP BY 1) WHERE c_name <> '' AND len(keys) > 1""")
def identity_clashes(t):
    c = F.col("c_custkey")
    rows = t("customer").select(c.alias("key"), F.when(c % 9 == 0, "").otherwise(F.concat(F.lit("n"), (c % 700).cast("string"))).alias("identity"))
    return C.duplicate_groups(rows, "identity")


@query("""WITH u AS (SELECT c_custkey AS unit_id, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey // 5 * 5 END AS parent_id FROM customer), o AS (SELECT * FROM u WHERE unit_id % 41 = 0),
r AS (SELECT unit_id FROM o UNION SELECT parent_id FROM o WHERE parent_id IS NOT NULL) SELECT unit_id FROM r UNION SELECT unit_id FROM u WHERE parent_id IN (SELECT unit_id FROM r)""")
def scopes(t):
    c = F.col("c_custkey")
    units = t("customer").select(c.alias("unit_id"), F.when(c % 5 != 0, F.floor(c / 5) * 5).alias("parent_id"))
    return C.scope_closure(units, units.where("unit_id % 41 = 0"))


@query("""SELECT DISTINCT l_orderkey AS unit_id, l_linenumber AS revision FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey % 7 + 1 = l_linenumber)""")
def pending(t):
    inputs = t("lineitem").select(F.col("l_orderkey").alias("unit_id"), F.col("l_linenumber").cast("long").alias("revision"))
    return C.pending_inputs(inputs, t("orders").select(F.col("o_orderkey").alias("unit_id"), (F.col("o_custkey") % 7 + 1).alias("revision")))


@query("""SELECT o_orderkey AS requirement_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS derivation_id, CASE WHEN o_orderkey % 3 <> 0 AND o_custkey % 2 = 0 THEN c_mktsegment END AS derivation_state FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def selections(t):
    o = t("orders")
    chosen = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("requirement_id"), F.col("o_custkey").alias("derivation_id"))
    derived = t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("derivation_id"), F.col("c_mktsegment").alias("state"))
    return C.selected_derivations(o.select(F.col("o_orderkey").alias("requirement_id")), chosen, derived).select("requirement_id", "derivation_id", "derivation_state")


@query("""SELECT c_custkey AS unit_id, (CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN ['receipts'] ELSE [] END) || (CASE WHEN c_custkey % 10 = 0 THEN ['manifests'] ELSE [] END) AS missing FROM customer
WHERE c_custkey % 10 = 0 OR c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def promotion_misses(t):
    units = t("customer").select(F.col("c_custkey").alias("unit_id"))
    return C.promotion_gaps(units, receipts=t("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("unit_id")), manifests=units.where("unit_id % 10 <> 0"))


@query("""SELECT md5('g2' || chr(31) || c_custkey) AS job_id, 'g2' AS generation, c_mktsegment FROM customer WHERE c_nationkey % 2 = 0""")
def forks(t):
    rows = t("customer").select(F.col("c_custkey").alias("job_id"), F.when(F.col("c_nationkey") % 2 == 0, "g1").otherwise("g0").alias("generation"), "c_mktsegment")
    return C.fork_generation(rows, "g1", "g2", "job_id")


@query("""SELECT s_nationkey AS backend, count(*) FILTER (s_suppkey % 4 < 3) = 3 AS degraded FROM supplier GROUP BY 1""")
def backend_health(t):
    return C.source_health(t("supplier").select(F.col("s_nationkey").alias("backend"), (F.col("s_suppkey") % 4 < 3).alias("degraded")), 3)


@query("""SELECT doc_id, 'Title: Doc ' || doc_id || chr(10) || 'Authors: A, B' || chr(10) || 'Abstract: ' || trim(plain[1:6000]) AS doc FROM (SELECT doc_id, replace(replace(replace(replace(replace(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS plain FROM documents) WHERE plain <> ''""")
def abstract_documents(t):
    doc = C.abstract_document(F.concat(F.lit("Doc "), F.col("doc_id").cast("string")), F.array(F.lit("A"), F.lit("B")), F.lit(None).cast("int"), F.lit(" "), F.col("text"))
    return t("documents").select("doc_id", doc.alias("doc")).where("doc IS NOT NULL")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'canon' WHEN doc_id % 3 = 1 THEN 'fulltext' ELSE 'abstract_only' END AS kind, 'd' || doc_id AS key FROM documents""")
def source_labels(t):
    d = F.col("doc_id")
    key = F.concat(F.lit("d"), d.cast("string"))
    label = C.source_label(F.when(d % 3 == 0, F.concat(F.lit("doc/"), key, F.lit("#s2"))).when(d % 3 == 1, F.concat(F.lit("paper/"), key)).otherwise(F.concat(F.lit("abstract/"), key)))
    return t("documents").select("doc_id", label["kind"].alias("kind"), label["key"].alias("key"))


@query("""SELECT o_orderkey, ['Solar wind', 'k' || o_custkey, 'b', 'c', 'd', 'e', 'f', 'g'] AS terms FROM orders""")
def search_terms(t):
    k = F.concat(F.lit(" k"), F.col("o_custkey").cast("string"))
    return t("orders").select("o_orderkey", C.planned_terms(F.array(*[F.lit(x) if isinstance(x, str) else x for x in ("Solar  wind", "", k, "solar wind ", "b", "B", "c", "d", "e", "f", "g", "h")])).alias("terms"))


@query()
def venue_ranks(t):
    rows = t("part").select("p_partkey", F.concat(F.lit("Journal of "), "p_name").alias("venue"), F.when(F.col("p_size") % 3 == 0, "10.1/x").otherwise("").alias("doi"), F.lit("").alias("arxiv_id"), (F.col("p_size") % 9).alias("citation_count"))
    return C.venue_tiers(rows, {"journal of small ring": 1.5, "journal of red widget": 1.2}, {"10.1/": 1.2}, "blue").select("p_partkey", "tier")


@query("""SELECT o_orderkey, unnest([0, 1]) AS idx, unnest([0.5, 0.0]) AS score FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 3, 1.0 FROM orders WHERE o_orderkey % 2 <> 0""")
def judged(t):
    reply = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('[{"idx": 0, "score": 0.5}, {"idx": 1, "score": "NaN"}]'))).otherwise('noise {"idx": 3, "score": 7} {broken')
    return t("orders").select("o_orderkey", F.explode(C.judged_items(reply)).alias("x")).select("o_orderkey", "x.*")
