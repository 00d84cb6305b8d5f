"""Queries of evaluation runs, decision rules and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import catalog as C
from lectern.operators import evaluation as E
from lectern.operators import graphs as G
from lectern.operators import ledgers as L
from lectern.operators import predicates as P
from lectern.operators import sync as S
from lectern.operators.lineage import folder
from lectern.plans import states  # noqa: F401  the batch twins' SQL
from lectern.plans.registry import ORACLE, query
from lectern.plans.relations import Said
from lectern.sources import files
from lectern.streaming import operators as stream

# Evaluation runs


def _gold(t):
    """An order's gold: its suppliers in threes; orders in sevens are traps."""
    s = F.col("l_suppkey")
    return t("lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.array_sort(F.collect_set(F.when((s % 3 == 0) & (F.col("l_orderkey") % 7 != 0), s))).alias("gold_keys"))


def _results(t):
    s, n = F.col("l_suppkey"), F.col("l_linenumber")
    per = t("lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.collect_list(F.when(n % 2 == 1, s)).alias("served"), F.collect_list(F.when((n % 3 == 0) | (s % 6 == 0), s)).alias("cited"), F.collect_list(F.when(n > 2, s)).alias("told"))
    return per.select("qid", "served", "cited", F.when(F.col("qid") % 4 != 0, F.col("told")).alias("prose"), (F.col("qid") % 5 != 0).alias("answered"))


_RUN = """WITH l AS (SELECT l_orderkey AS qid, l_suppkey AS s, l_linenumber AS n FROM lineitem), r AS (SELECT qid, coalesce(list(DISTINCT s) FILTER (s % 3 = 0 AND qid % 7 <> 0), []) AS gold, coalesce(list(DISTINCT s) FILTER (n % 2 = 1), []) AS served, coalesce(list(DISTINCT s) FILTER (n % 3 = 0 OR s % 6 = 0), []) AS cited, coalesce(list(DISTINCT s) FILTER (n > 2), []) AS told FROM l GROUP BY qid),
m AS (SELECT *, len(list_intersect(gold, served)) AS hits, len(list_intersect(gold, cited)) AS cites, len(list_filter(cited, lambda x: NOT list_contains(served, x))) AS strange, len(list_filter(told, lambda x: NOT list_contains(served, x))) AS untrue FROM r)
"""


@query(_RUN + """SELECT qid, round(CAST(hits AS DOUBLE) / len(gold), 9) AS recall, round(CAST(cites AS DOUBLE) / len(gold), 9) AS citation_recall, round(CASE WHEN qid % 4 = 0 THEN CAST(strange AS DOUBLE) / greatest(1, len(cited)) WHEN len(told) > 0 THEN CAST(untrue AS DOUBLE) / len(told) END, 9) AS hallucinated FROM m WHERE len(gold) > 0""")
def answers_scored(t):
    return E.served_metrics(_results(t), _gold(t)).select("qid", *[F.round(c, 9).alias(c) for c in ("recall", "citation_recall", "hallucinated")])


@query(_RUN + """SELECT count(*) AS n, count(*) FILTER (len(gold) = 0) AS n_traps, count(*) FILTER (len(gold) > 0) AS n_answerable, round(avg(CAST(hits AS DOUBLE) / len(gold)) FILTER (len(gold) > 0), 6) AS recall, round(avg(CAST(cites AS DOUBLE) / len(gold)) FILTER (len(gold) > 0), 6) AS citation_recall,
round(avg(CAST(strange AS DOUBLE) / len(cited)) FILTER (len(gold) > 0 AND len(cited) > 0), 6) AS hallucinated, round(avg(CAST(qid % 5 <> 0 AND len(cited) > 0 AS INTEGER)) FILTER (len(gold) = 0), 6) AS trap_violation, round(avg(CAST(len(cited) > 0 AND cites = 0 AS INTEGER)) FILTER (len(gold) > 0), 6) AS overconfident FROM m""")
def runs_evaluated(t):
    out = E.run_evaluation(_results(t), _gold(t))
    return out.select("n", "n_traps", "n_answerable", *[F.round(c, 6).alias(c) for c in ("recall", "citation_recall", "hallucinated", "trap_violation", "overconfident")])


@query("""WITH s AS (SELECT l_orderkey AS qid, l_suppkey AS key, min(l_linenumber - 1) AS first FROM lineitem GROUP BY 1, 2), g AS (SELECT DISTINCT l_orderkey AS qid, l_suppkey + l_partkey % 2 AS key FROM lineitem), c AS (SELECT unnest([1, 3, 12]) AS cut)
SELECT g.qid, cut, round(count(*) FILTER (first < cut) / CAST(count(*) AS DOUBLE), 9) AS recall FROM g CROSS JOIN c LEFT JOIN s ON s.qid = g.qid AND s.key = g.key GROUP BY g.qid, cut""")
def recall_curves(t):
    served = t("lineitem").select(F.col("l_orderkey").alias("qid"), (F.col("l_linenumber") - 1).alias("rank"), F.col("l_suppkey").alias("key"))
    gold = t("lineitem").select(F.col("l_orderkey").alias("qid"), (F.col("l_suppkey") + F.col("l_partkey") % 2).alias("key"))
    return E.recall_curve(served, gold, [1, 3, 12]).select("qid", "cut", F.round("recall", 9).alias("recall"))


_SIDE = {side: Said("customer", {"metric": "c_mktsegment", "qid": "c_custkey", "value": f"CAST(c_custkey % {m} AS DOUBLE) / 4"}, w) for side, m, w in (("a", 5, "true"), ("b", 7, "c_mktsegment <> 'FURNITURE' OR c_custkey % 50 > 0"))}


def _paired(t):
    a, b = (_SIDE[s](t).withColumnRenamed("value", s) for s in "ab")
    return a.join(b, ["metric", "qid"])


@query()  # resampling: tested against each interval by itself
def mover_jackknives(t):
    return E.mover_jackknife(_paired(t))


@query(f"""WITH a AS {_SIDE["a"]}, b AS {_SIDE["b"]} SELECT metric, qid, a.value AS a, b.value AS b FROM a JOIN b USING (metric, qid) WHERE a.value <> b.value""")
def movers(t):
    return E.movable(_paired(t))


@query(f"""WITH a AS {_SIDE["a"]}, b AS {_SIDE["b"]}, p AS (SELECT metric, count(*) FILTER (b.value IS NULL) AS miss, avg(a.value) FILTER (b.value IS NOT NULL) AS x, avg(b.value) AS y FROM a LEFT JOIN b USING (metric, qid) GROUP BY metric), r AS (SELECT * FROM (VALUES ('BUILDING', true, 0.5), ('MACHINERY', false, 0.1), ('FURNITURE', true, 9.0), ('absent', true, 1.0)) AS t(metric, up, eps))
SELECT metric, NOT coalesce(miss = 0, false) OR coalesce(CASE WHEN up THEN x - y ELSE y - x END > eps, true) AS regressed, coalesce(miss = 0, false) AS evaluable, coalesce(miss, 0) AS n_missing FROM r LEFT JOIN p USING (metric)""")
def mean_gate_report(t):
    rules = t("customer").sparkSession.createDataFrame([("BUILDING", True, 0.5), ("MACHINERY", False, 0.1), ("FURNITURE", True, 9.0), ("absent", True, 1.0)], "metric string, higher_is_better boolean, epsilon double")
    return E.mean_gates(_SIDE["a"](t), _SIDE["b"](t), rules)


_COMPARED = Said("nation", {"metric": "n_name", "ci_low": "CAST(n_nationkey % 5 - 2 AS DOUBLE)", "ci_high": "CAST(n_nationkey % 5 - 1 AS DOUBLE)", "p": "CAST(n_nationkey % 3 AS DOUBLE) / 50", "mean_a": "CAST(n_nationkey % 4 AS DOUBLE)", "mean_b": "CAST(2 AS DOUBLE)"}, "n_nationkey % 6 <> 0")


@query(f"""WITH c AS {_COMPARED} SELECT n_name AS metric, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN ci_high < 0 ELSE ci_low > 0 END AND p < 0.05 OR CASE WHEN n_nationkey % 2 = 0 THEN mean_a - mean_b ELSE mean_b - mean_a END > 0.5, true) AS regressed FROM nation LEFT JOIN c ON metric = n_name""")
def paired_gate_report(t):
    rules = t("nation").select(F.col("n_name").alias("metric"), (F.col("n_nationkey") % 2 == 0).alias("higher_is_better"), F.lit(0.5).alias("epsilon"))
    return E.paired_gates(_COMPARED(t), rules)


@query("""WITH i AS (SELECT o_orderkey AS qid, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS type FROM orders), p AS (SELECT o_orderkey AS qid, o_custkey % 100 / 100.0 AS v FROM orders WHERE o_orderkey % 3 > 0)
SELECT coalesce(type, '?') AS type, count(v) AS n, round(avg(v), 6) AS precision, count(*) FILTER (qid % 5 > qid % 4) AS under_judged, count(*) FILTER (v IS NULL) AS unscored FROM i LEFT JOIN p USING (qid) GROUP BY 1""")
def precision_by_type(t):
    o = F.col("o_orderkey")
    intents = t("orders").select(o.alias("qid"), F.when(o % 4 > 0, F.col("o_orderpriority")).alias("type"))
    precision = t("orders").where(o % 3 > 0).select(o.alias("qid"), (F.col("o_custkey") % 100 / 100).alias("precision"))
    out = E.breakdown(precision, intents, t("orders").where(o % 4 > 0).select(o.alias("qid"), (o % 4).alias("n")), t("orders").select(o.alias("qid"), (o % 5).alias("n")))
    return out.withColumn("precision", F.round("precision", 6))


@query("""WITH p AS (SELECT c_custkey AS qid, 'bad band' AS problem FROM customer WHERE c_custkey % 11 = 0 UNION ALL SELECT c_custkey, 'repeated gold key' FROM customer WHERE c_custkey % 3 > 0 AND c_custkey % 7 = 0 UNION ALL SELECT c_custkey, 'bad label' FROM customer WHERE c_custkey % 13 = 0
UNION ALL SELECT c_custkey, 'trap with nuggets' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 11 > 0 AND c_custkey % 9 > 0 UNION ALL SELECT c_custkey, 'no gold' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 11 = 0
UNION ALL SELECT c_custkey, 'trap with an answering paper' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 11 > 0 AND c_custkey % 13 > 0 UNION ALL SELECT c_custkey, 'number of nuggets' FROM customer WHERE (c_custkey % 3 > 0 OR c_custkey % 11 = 0) AND c_custkey % 9 NOT BETWEEN 3 AND 7
UNION ALL SELECT c_custkey, 'gold is not the answering papers' FROM customer WHERE (c_custkey % 3 > 0 OR c_custkey % 11 = 0) AND (CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 13 = 0 ELSE c_custkey % 13 > 0 END) UNION ALL SELECT c_custkey, 'unknown key k' || c_custkey FROM customer WHERE c_custkey % 10 = 1)
SELECT * FROM p""")
def gold_checked(t):
    c = F.col("c_custkey")
    key = F.concat(F.lit("k"), c.cast("string"))
    none = F.array().cast("array<string>")
    band = F.when(c % 11 == 0, "odd").when(c % 3 == 0, "empty").otherwise("strong")
    keys = F.when(c % 3 == 0, none).when(c % 7 == 0, F.array(key, key)).otherwise(F.array(key))
    nuggets = F.array_repeat(F.lit("n"), (c % 9).cast("int"))
    gold = t("customer").select(c.alias("qid"), band.alias("band"), keys.alias("gold_keys"), nuggets.alias("nuggets"), F.create_map(key, F.when(c % 13 == 0, "odd").otherwise("directly-answering")).alias("relevance"))
    return E.gold_problems(gold, t("customer").where(c % 10 != 1).select(key.alias("key")), ["empty", "strong"], ["directly-answering", "context"])


@query("""WITH p AS (SELECT p_partkey % 50 AS qid, p_partkey AS w, p_name AS title, string_split(p_name, ' ') AS ws FROM part WHERE p_partkey % 2 = 0), s AS (SELECT p_partkey % 50 - p_partkey % 2 AS qid, p_name AS title, string_split(p_name, ' ') AS ws FROM part WHERE p_partkey % 2 = 1 AND p_partkey % 50 > 9),
h AS (SELECT qid, w, EXISTS (SELECT 1 FROM s WHERE s.qid = p.qid AND CAST(len(list_intersect(p.ws, s.ws)) AS DOUBLE) / len(list_distinct(p.ws || s.ws)) >= 0.8) AS hit FROM p)
SELECT qid, CASE WHEN NOT (qid < 10 OR qid % 20 = 12) THEN round(count(*) FILTER (hit) / CAST(count(*) AS DOUBLE), 9) END AS recall, qid < 10 OR qid % 20 = 12 AS quarantined FROM h GROUP BY qid""")
def must_finds(t):
    k = F.col("p_partkey")
    pools = t("part").where(k % 2 == 0).select((k % 50).alias("qid"), k.alias("want_id"), F.col("p_name").alias("title"), F.lit("").alias("doi"))
    served = t("part").where((k % 2 == 1) & (k % 50 > 9)).select((k % 50 - k % 2).alias("qid"), k.alias("key"), F.col("p_name").alias("title"), F.lit("").alias("doi"))
    failed = t("part").where(k % 20 == 12).select((k % 50).alias("qid")).where("qid % 20 = 12")
    return E.must_find_recall(pools, served, failed).select("qid", F.round("recall", 9).alias("recall"), "quarantined")


@query("SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(CASE WHEN l_linenumber > 2 THEN l_discount END), 6) AS late FROM lineitem WHERE l_returnflag <> 'A'")
def metric_means(t):
    rows = t("lineitem").withColumn("late", F.when(F.col("l_linenumber") > 2, F.col("l_discount")))
    return E.mean_metrics(rows, ["l_quantity", "late"], F.col("l_returnflag") != "A").select(F.round("l_quantity", 6).alias("l_quantity"), F.round("late", 6).alias("late"))


@query("SELECT event_type AS metric, user_id AS qid, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def run_mean_tables(t):
    return E.run_means(t("events").select(F.col("event_type").alias("metric"), F.col("user_id").alias("qid"), "value")).withColumn("value", F.round("value", 6))


@query("SELECT l_orderkey AS qid, round(avg(CASE WHEN l_discount >= 0.07 THEN 1.0 ELSE 0.0 END), 6) AS p_served FROM lineitem GROUP BY 1")
def served_precisions(t):
    return E.served_precision(t("lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_discount").alias("score")), 0.07).select("qid", F.round("p_served", 6).alias("p_served"))


@query("""SELECT c_custkey AS qid, (CASE WHEN c_custkey % 5 = 0 THEN ['ims'] ELSE [] END) || (CASE WHEN c_custkey % 7 = 0 THEN ['nugget_recall'] ELSE [] END) || (CASE WHEN c_custkey % 9 > 5 THEN ['relevance'] ELSE [] END) || (CASE WHEN c_custkey % 4 > 2 THEN ['claims'] ELSE [] END) AS problems FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 9 > 5 OR c_custkey % 4 > 2""")
def judgements_checked(t):
    c = F.col("c_custkey")
    return E.judge_violations(t("customer").select(c.alias("qid"), F.when(c % 5 == 0, 101.0).otherwise(50.0).alias("ims"), F.when(c % 7 == 0, -0.1).when(c % 3 == 0, 1.0).alias("nugget_recall"), (c % 9).alias("relevance"), (c % 4).alias("n_claims_with_citation"), F.lit(2).alias("n_substantive_claims")))


@query("SELECT n_nationkey AS metric, n_nationkey % 2 = 0 AND n_nationkey % 5 > 2 AND n_nationkey % 3 > 0 AND n_nationkey < 20 AS ship FROM nation")
def verdicts(t):
    out = None
    n = F.col("n_nationkey")
    for k in range(25):
        one = t("nation").where(n == k)
        c = one.select(n.alias("metric"), (n % 2 == 0).alias("improved"), (n % 5).cast("double").alias("delta"))
        v = E.verdict(c, one.select(n.alias("metric"), (n % 3 > 0).alias("stable")), one.select((n < 20).alias("passed")), k, 2.0).select(F.lit(k).alias("metric"), "ship")
        out = v if out is None else out.unionByName(v)
    return out


# Decision rules


@query("SELECT c_custkey AS key FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 3 <> 0")
def records_in_view(t):
    c = F.col("c_custkey")
    return P.clean_view(t("customer").select(c.alias("key"), F.when(c % 5 == 0, True).when(c % 2 == 0, False).alias("quarantine"), F.when(c % 3 == 0, "x").alias("alias_key"))).select("key")


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 6 = 0 THEN 'blank_title' WHEN c_custkey % 6 = 1 THEN 'short_title' WHEN c_custkey % 6 = 2 THEN 'no_letters' WHEN c_custkey % 4 = 3 THEN 'blank_authors' ELSE '' END AS reason FROM customer""")
def phantoms(t):
    c = F.col("c_custkey")
    title = F.when(c % 6 == 0, "  ").when(c % 6 == 1, "abc").when(c % 6 == 2, "12345 6").otherwise(F.col("c_name"))
    authors = F.when(c % 4 == 3, F.array(F.lit(" "), F.lit(""))).when(c % 4 == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit(""), F.lit("A")))
    return t("customer").select(c.alias("key"), P.phantom_reason(title, authors).alias("reason"))


@query("""SELECT o_orderkey, o_orderkey % 2 = 0 AND o_custkey % 3 = 0 AS admitted, CASE o_orderkey % 6 WHEN 0 THEN 'AVAILABLE' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'PENDING' ELSE 'UNKNOWN' END AS retrieval, CASE o_orderkey % 6 WHEN 3 THEN 'EXCLUDED' WHEN 5 THEN 'UNKNOWN' ELSE 'CLEAR' END AS policy,
o_orderkey % 3 < 2 AND o_custkey % 5 < 3 AS reopens, o_orderkey % 7 > 3 AS flag FROM orders""")
def admissions(t):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    status = F.get(F.array(*map(F.lit, ("ok", "not_found", "pending", "excluded", "odd"))), (o % 6).cast("int"))
    legacy = P.legacy_status(status)
    state = F.when(o % 3 == 0, "FAILED").when(o % 3 == 1, "PENDING")
    flag = F.get(F.array(*map(F.lit, ("false", " FALSE ", "0", "", "true", "1", "yes"))), (o % 7).cast("int"))
    return t("orders").select("o_orderkey", P.admission(F.when(o % 2 == 0, True).when(o % 4 == 1, False), c % 3 == 0).alias("admitted"), legacy["retrieval"].alias("retrieval"), legacy["policy"].alias("policy"), P.reopenable(state, c % 5, 3).alias("reopens"), P.coerced_flag(flag).alias("flag"))


_NEEDY = Said("customer", {"key": "c_custkey", "abstract": "CASE WHEN c_custkey % 2 = 0 THEN ' ' WHEN c_custkey % 4 = 1 THEN 'a' END", "doi": "CASE WHEN c_custkey % 3 = 0 THEN '10.1/x' END", "title": "CASE WHEN c_custkey % 5 > 0 THEN c_name ELSE '' END", "year": "CASE WHEN c_custkey % 7 > 0 THEN 2000 END"})


@query(f"""WITH r AS {_NEEDY} SELECT 'abstract' AS what, key FROM r WHERE trim(coalesce(abstract, '')) = '' UNION ALL SELECT 'doi', key FROM r WHERE doi IS NULL AND title <> '' UNION ALL SELECT 'enrich', key FROM r WHERE trim(coalesce(abstract, '')) = '' OR doi IS NULL OR year IS NULL""")
def records_in_need(t):
    out = [P.needs(_NEEDY(t), what).select(F.lit(what).alias("what"), "key") for what in ("abstract", "doi", "enrich")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT c_nationkey, CASE WHEN min(c_custkey % 40) = 0 THEN 'missing' WHEN min(c_custkey % 40) < 3 THEN 'stale' ELSE 'present' END AS worst FROM customer GROUP BY 1")
def worst_states(t):
    k = F.col("c_custkey") % 40
    rows = t("customer").select("c_nationkey", F.when(k == 0, "missing").when(k < 3, "stale").otherwise("present").alias("state"))
    return G.worst_of(rows, ["c_nationkey"], "state", ["missing", "stale", "present"])


@query("""SELECT o_orderkey, greatest(coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END, 0), coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 700 END, 0)) + 1 AS revision, o_orderkey % 4 = 1 AND o_custkey % 3 > 0 AND o_custkey % 5 = 2 AS valid, CAST(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END, 0) * 3.0 + o_orderkey % 10 * 3.0 + 60 AS DOUBLE) AS eta,
CAST(greatest(0, o_orderkey % 9 + 1 - 4) * 2.5 AS DOUBLE) AS wait, CASE WHEN o_orderkey % 2 = 1 THEN 'unmatched' WHEN o_custkey % 3 = 0 THEN 'not_registered' WHEN o_custkey % 3 = 1 THEN 'not_readable' WHEN o_custkey % 5 < 3 THEN 'not_indexed' ELSE '' END AS reason FROM orders""")
def claims(t):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    valid = L.claim_valid(F.lit(5), o % 4, F.lit(1), F.lit(7), F.lit(7), F.when(c % 3 > 0, F.lit(9)), F.lit(5), F.when(c % 5 == 2, 6).otherwise(5))
    reason = G.difference_reason(F.when(o % 2 == 0, True), c % 3 > 0, c % 3 > 1, F.when(c % 5 > 2, True))
    return t("orders").select("o_orderkey", C.next_revision(F.when(o % 2 == 0, c), F.when(o % 3 == 0, 700)).alias("revision"), valid.alias("valid"), C.eta_seconds(F.when(o % 3 == 0, c), o % 10).cast("double").alias("eta"), L.admission_wait(o % 9, 4, F.lit(2.5)).cast("double").alias("wait"), reason.alias("reason"))


@query("""SELECT c_custkey AS key, 'q' || c_custkey AS query, CASE WHEN c_custkey % 2 = 0 THEN ['h'] ELSE [] END AS hl FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 'second', ['x', 'y'] FROM customer WHERE c_custkey % 3 > 0""")
def facets_read(t):
    c = F.col("c_custkey")
    first = F.concat(F.lit('{"query": "q'), c.cast("string"), F.when(c % 2 == 0, '", "hl": ["h"], "ll": []}').otherwise('", "hl": [], "ll": ["l"]}'))
    reply = F.when(c % 3 == 0, "no json").otherwise(F.concat(F.lit("["), first, F.lit(', {"query": "second", "hl": ["x", "y"], "ll": []}, {"query": "third", "hl": [], "ll": []}]')))
    return t("customer").select(c.alias("key"), F.explode(C.facets(reply, 2)).alias("f")).select("key", "f.query", "f.hl")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > 0.05 AND (SELECT count(*) FROM lineitem WHERE l_tax > 0.05) > 100")
def mismatched(t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_tax")
    return L.mismatches(rows, F.col("l_tax") > 0.05, 100).unionByName(L.mismatches(rows, F.col("l_tax") > 0.05, 10**12)).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name > 'Customer#000000042' ORDER BY c_name LIMIT 25")
def next_page(t):
    return files.ranked_page(t("customer").select("c_custkey", "c_name"), "c_name", "Customer#000000042", 25)


@query("SELECT n_nationkey, n_name FROM nation")
def log_lines(t):
    rows = t("nation").select("n_nationkey", "n_name")
    spark = rows.sparkSession
    path = f"{folder(spark)}/lectern/log-{uuid.uuid4().hex}"
    files.append_log(rows.where("n_nationkey < 9"), path)
    files.append_log(rows.where("n_nationkey >= 9"), path)
    return spark.read.schema(rows.schema).json(path)


# Streams


def streamed(rows: DataFrame) -> DataFrame:
    """The rows as a stream of one pass, from files written for it."""
    spark = rows.sparkSession
    path = f"{folder(spark)}/lectern/stream-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def drained(out: DataFrame, mode: str) -> DataFrame:
    """What a stream has given when its input ends, by a sink of one folder an epoch."""
    spark = out.sparkSession
    path = f"{folder(spark)}/lectern/drained-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    out.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").foreachBatch(sink).trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema(out.schema).parquet(f"{path}/epoch=*")
    return kept


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, max(value) AS largest, count(*) FILTER (value > 20) AS over, count(*) AS samples FROM events GROUP BY 1")
def lags_streamed(t):
    out = stream.lag_rollup(streamed(t("events").select(F.col("ts").cast("timestamp").alias("ts"), "value")), "ts", "value", 20.0, "1 hour")
    return drained(out, "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "largest", "over", "samples")


@query(ORACLE["breaker_states"])
def breakers_streamed(t):
    e = t("events").select("user_id", F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").cast("double").alias("at"), (F.col("event_type") == "error").alias("failed"))
    return drained(stream.breaker(streamed(e), "user_id", 3, 86400.0, 3600.0), "append")


@query(ORACLE["attempts"])
def attempts_streamed(t):
    kind = F.col("event_type")
    status = F.when(kind == "error", "error").when(kind == "purchase", "done").otherwise("processing")
    fp = F.when(kind == "signup", F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")))
    e = t("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), status.alias("status"), fp.alias("fingerprint"))
    return drained(stream.attempts(streamed(e)), "append")
