"""Queries of the sync, state, coverage and evaluation families."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import evaluation as E
from lectern.operators import graphs as G
from lectern.operators import ledgers as L
from lectern.operators import sync as S
from lectern.plans.registry import query


def second(c):
    return F.col(c).cast("timestamp")


def both_sides(t):
    """An index and a ledger over orders: keys missing on either side, changed values, statuses."""
    o = F.col("o_orderkey")
    index = t("orders").where(o % 7 != 0).select(o.alias("key"), F.concat(F.lit("f"), (F.col("o_custkey") % 5).cast("string")).alias("fingerprint"))
    status = F.when(o % 11 == 0, "error").when(o % 11 == 1, "error_parked").when(o % 11 == 2, "pending_remove").otherwise("done")
    ledger = t("orders").where(o % 5 != 0).select(o.alias("key"), F.concat(F.lit("f"), F.when(o % 13 == 0, "x").otherwise((F.col("o_custkey") % 5).cast("string"))).alias("fingerprint"), status.alias("status"))
    return index, ledger


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'distill' WHEN o_orderkey % 7 = 0 THEN 'remove' ELSE 'redistill' END AS action FROM orders
WHERE (o_orderkey % 7 <> 0 OR o_orderkey % 5 <> 0) AND (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 11 IN (0, 2))""")
def snapshot_diffs(t):
    return S.snapshot_diff(*both_sides(t))


@query("""WITH l AS (SELECT o_orderstatus AS source, o_orderkey AS source_id, 'd' || o_orderkey AS doc_id, 'f' || o_custkey AS fingerprint, o_orderkey % 2 = 0 AS processed FROM orders),
w AS (SELECT fingerprint, arg_min(doc_id, source || lpad(CAST(source_id AS VARCHAR), 12, '0')) AS twin_doc FROM l WHERE processed GROUP BY 1)
SELECT source, source_id, twin_doc FROM l JOIN w USING (fingerprint) WHERE NOT processed""")
def twin_adoptions(t):
    o = F.col("o_orderkey")
    ledger = t("orders").select(F.col("o_orderstatus").alias("source"), o.alias("source_id"), F.concat(F.lit("d"), o.cast("string")).alias("doc_id"), F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("fingerprint"), (o % 2 == 0).alias("processed"), F.lit("done").alias("status"))
    return S.twin_adoption(ledger)


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'done' WHEN o_orderkey % 4 = 1 THEN 'error' WHEN o_custkey % 3 = 2 THEN 'error' ELSE 'processing' END AS status,
CASE WHEN o_orderkey % 4 = 3 THEN CAST(o_custkey % 3 + 1 AS BIGINT) ELSE 0 END AS rounds FROM orders""")
def write_backs(t):
    o = F.col("o_orderkey")
    ledger = t("orders").select(o.alias("key"), o.alias("doc_id"), F.lit("processing").alias("status"), (F.col("o_custkey") % 3).alias("rounds"))
    states = t("orders").where(o % 4 != 3).select(o.alias("doc_id"), F.when(o % 2 == 0, "processed").otherwise("failed").alias("state"))
    return S.write_back(ledger, states).select("key", "status", F.col("rounds").cast("long").alias("rounds"))


def journal(t):
    op = F.when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    return t("events").select((F.col("event_id") + 1).alias("sequence"), F.col("user_id").alias("row_id"), op.alias("operation"), F.struct("event_type", "value").alias("new_row"))


@query("""SELECT row_id, event_type, value FROM (SELECT user_id AS row_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id) WHERE event_type <> 'error'""")
def change_folds(t):
    return S.change_fold(journal(t))


@query("""SELECT event_id + 1 AS sequence, user_id AS row_id FROM events WHERE event_id + 1 > 9000""")
def change_deltas(t):
    return S.change_delta(journal(t), 9000).select("sequence", "row_id")


@query("""SELECT coalesce(a.k, b.k) AS key, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'both' END AS side,
CASE WHEN a.k IS NULL OR b.k IS NULL THEN [] ELSE (CASE WHEN a.n <> b.n THEN ['n'] ELSE [] END) || (CASE WHEN a.m IS DISTINCT FROM b.m THEN ['m'] ELSE [] END) END AS differs
FROM (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS m FROM customer WHERE c_custkey % 9 <> 0) a
FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS n, CASE WHEN c_custkey % 6 <> 0 THEN c_mktsegment END AS m FROM customer WHERE c_custkey % 8 <> 0) b ON a.k = b.k""")
def catalog_differences(t):
    c = F.col("c_custkey")
    left = t("customer").where(c % 9 != 0).select(c.alias("key"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("m"))
    right = t("customer").where(c % 8 != 0).select(c.alias("key"), F.when(c % 4 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("n"), F.when(c % 6 != 0, F.col("c_mktsegment")).alias("m"))
    return S.catalog_compare(left, right, "key", ["n", "m"])


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'l' WHEN c_custkey % 3 = 0 THEN 'r' ELSE 'b' END AS title, CASE WHEN c_custkey % 5 = 0 THEN 'r' ELSE 'b' END AS secret,
c_custkey % 6 = 0 OR c_custkey % 5 = 0 AS conflict FROM customer""")
def three_way_merges(t):
    c = F.col("c_custkey")
    rows = t("customer").select(c.alias("key"), F.lit("b").alias("base_title"), F.when(c % 2 == 0, "l").otherwise("b").alias("local_title"), F.when(c % 3 == 0, "r").otherwise("b").alias("remote_title"), F.lit("b").alias("base_secret"), F.lit("b").alias("local_secret"), F.when(c % 5 == 0, "r").otherwise("b").alias("remote_secret"))
    return S.three_way_merge(rows, ["title", "secret"], ["title"])


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 'old' WHEN c_custkey % 5 <> 0 THEN 'new' WHEN c_custkey % 3 <> 0 THEN ' ' END AS title,
CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 20 WHEN c_custkey % 5 = 0 THEN c_custkey % 10 ELSE greatest(c_custkey % 10, c_custkey % 20) END AS cites, c_custkey % 3 <> 0 AND c_custkey % 4 = 0 AS review
FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_custkey % 5 = 0)""")
def filled_blanks(t):
    c = F.col("c_custkey")
    old = t("customer").where(c % 3 != 0).select(c.alias("key"), F.when(c % 2 == 0, "old").otherwise(" ").alias("title"), (c % 10).alias("cites"), (c % 4 == 0).alias("review"))
    new = t("customer").where(c % 5 != 0).select(c.alias("key"), F.lit("new").alias("title"), (c % 20).alias("cites"), F.lit(None).cast("boolean").alias("review"))
    return S.fill_blanks(old, new, "key", ["title"], ["cites"], ["review"])


@query("""SELECT k AS key, CASE WHEN w % 5 = 0 THEN CASE WHEN k % 2 = 0 THEN 'inserted' ELSE 'stale' END WHEN k % 3 = 0 THEN 'kept' WHEN k % 7 = 0 THEN 'stale' WHEN k % 2 = 0 THEN 'unchanged' ELSE 'updated' END AS outcome
FROM (SELECT c_custkey AS k, c_custkey AS w FROM customer) WHERE NOT (k % 5 = 0 AND k % 3 = 0)""")
def upserts(t):
    c = F.col("c_custkey")
    current = t("customer").where(c % 5 != 0).select(c.alias("key"), F.lit("p").alias("payload"), F.lit(3).alias("revision"))
    writes = t("customer").where(c % 3 != 0).select(c.alias("key"), F.when(c % 2 == 0, "p").otherwise("q").alias("payload"), F.when((c % 5 == 0) & (c % 2 == 0), 0).when(c % 7 == 0, 2).otherwise(3).alias("expected"))
    return S.optimistic_upsert(current, writes).select("key", "outcome")


@query("""WITH n AS (SELECT c_custkey, lower(c_mktsegment) || c_nationkey AS base, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) - 1 AS n FROM customer)
SELECT c_custkey, base || CASE WHEN n = 0 THEN '' WHEN n <= 26 THEN chr(CAST(96 + n AS INTEGER)) ELSE '_' || (n - 26) END AS key FROM n""")
def allocated_keys(t):
    base = F.concat(F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"))
    none = t("customer").sparkSession.createDataFrame([], "key string, base string")
    return S.citation_keys(t("customer").select("c_custkey", "c_mktsegment", "c_nationkey"), base, none, "c_custkey").select("c_custkey", "key")


@query("""SELECT o_orderkey, (CASE WHEN a.c_custkey IS NOT NULL THEN ['c' || o_custkey] ELSE [] END) || (CASE WHEN b.c_custkey IS NOT NULL THEN ['c' || (o_custkey + 1)] ELSE [] END) AS ids, a.c_custkey IS NULL OR b.c_custkey IS NULL AS ghosts
FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey AND a.c_custkey % 3 <> 0 LEFT JOIN customer b ON b.c_custkey = o_custkey + 1 AND b.c_custkey % 3 <> 0""")
def scrubbed(t):
    k = F.col("o_custkey")
    rows = t("orders").select("o_orderkey", F.array(*[F.concat(F.lit("c"), x.cast("string")) for x in (k, k + 1, k)]).alias("ids"))
    valid = t("customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return S.scrub_references(rows, "ids", valid).select("o_orderkey", "ids", (F.col("n_ghosts") > 0).alias("ghosts"))


@query("""SELECT o_orderkey, o_orderstatus <> 'P' AND NOT o_orderdate > TIMESTAMP '1998-01-01' - INTERVAL 90 DAY AND o_custkey % 4 <> 0 AS collectable FROM orders""")
def retention(t):
    o = t("orders").select("o_orderkey", (F.col("o_orderstatus") == "P").alias("protected"), second("o_orderdate").alias("created_at"), F.lit(False).alias("current"), (F.col("o_custkey") % 4 == 0).alias("referenced"), F.lit(None).cast("boolean").alias("pinned"))
    return S.retention_plan(o, F.lit("1998-01-01").cast("timestamp")).select("o_orderkey", "collectable")


@query("""SELECT n_nationkey, sum(c_acctbal) IS NOT NULL AS some, coalesce(count(c_custkey), 0) + 5 <= 60 AS admitted, coalesce(count(c_custkey), 0) + 5 >= 48 AS alert FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey""")
def capacity(t):
    used = t("nation").join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.count("c_custkey").alias("used"), F.sum("c_acctbal").isNotNull().alias("some"))
    plan = S.capacity_plan(F.col("used"), F.lit(2), F.lit(3), F.lit(60))
    return used.select("n_nationkey", "some", plan["admitted"].alias("admitted"), plan["alert"].alias("alert"))


@query("""SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id""")
def latest_observations(t):
    return S.latest(t("events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey <= 700, c_custkey) AS n FROM customer) WHERE n <= 40 ORDER BY c_custkey <= 700, c_custkey LIMIT 150""")
def rotated_sweep(t):
    return S.rotated(t("customer"), "c_custkey", F.lit(700), 150, "c_mktsegment", 40).select("c_custkey")


@query("""WITH e AS (SELECT user_id AS key, event_id AS seq, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' ELSE 'processing' END AS status, CASE WHEN event_type = 'signup' THEN 'f' || event_id % 3 END AS fp FROM events),
k AS (SELECT *, last_value(fp IGNORE NULLS) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM e),
r AS (SELECT *, sum(CASE WHEN status <> 'error' AND (status = 'done' OR fp IS NOT NULL AND fp IS DISTINCT FROM prev) THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM k),
a AS (SELECT key, seq, status, CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY key, run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS attempts FROM r)
SELECT key, seq, attempts, CASE WHEN status = 'error' AND attempts >= 3 THEN 'error_parked' ELSE status END AS status FROM a""")
def attempts(t):
    kind = F.col("event_type")
    status = F.when(kind == "error", "error").when(kind == "purchase", "done").otherwise("processing")
    fp = F.when(kind == "signup", F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")))
    return L.attempt_machine(t("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), status.alias("status"), fp.alias("fingerprint")))


@query("""WITH r AS (SELECT user_id, event_type = 'error' AS bad, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM events)
SELECT user_id, CAST(max(n) AS BIGINT) AS longest, max(n) >= 3 AS opened FROM (SELECT user_id, run, count(*) FILTER (bad) AS n FROM r GROUP BY 1, 2) GROUP BY user_id""")
def streaks(t):
    return L.failure_streaks(t("events"), "user_id", "event_id", F.col("event_type") == "error", 3)


@query("""SELECT event_id, in_window FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id % 10 ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) - (row_number() OVER (PARTITION BY user_id % 10, ts ORDER BY event_id DESC) - 1) AS in_window FROM events) WHERE in_window > 3""")
def quota_violations(t):
    e = t("events").select("event_id", (F.col("user_id") % 10).alias("client"), second("ts").alias("ts"))
    return L.window_violations(e, "client", "ts", 3, 3600.0, "event_id").select("event_id", "in_window")


@query("""WITH r AS (SELECT user_id % 10 AS client, epoch_us(ts) / 1e6 AS at_s, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts DESC) AS n FROM events),
m AS (SELECT client, greatest(0, coalesce(max(CASE WHEN n = 5 THEN at_s END) + 86400 - epoch(TIMESTAMP '2024-02-01'), 0), coalesce(max(CASE WHEN n = 20 THEN at_s END) + 604800 - epoch(TIMESTAMP '2024-02-01'), 0)) AS wait FROM r GROUP BY client)
SELECT client, round(wait, 3) AS wait FROM m""")
def waits(t):
    e = t("events").select((F.col("user_id") % 10).alias("client"), second("ts").alias("ts"))
    return L.retry_after(e, "client", "ts", [(5, 86400.0), (20, 604800.0)], F.lit("2024-02-01").cast("timestamp")).select("client", F.round("wait", 3).alias("wait"))


@query("""SELECT CAST(o_custkey % 100 AS VARCHAR) AS identity, count(DISTINCT (o_orderkey % 50, o_orderstatus)) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT (o_orderkey % 50, o_orderstatus)) > 40""")
def in_flight(t):
    rows = t("orders").select((F.col("o_custkey") % 100).cast("string").alias("identity"), (F.col("o_orderkey") % 50).alias("key"), F.col("o_orderstatus").alias("lease_id"))
    return L.in_flight_duplicates(rows, 40)


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id AS seq, epoch(ts) AS t, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, 'CLOSED' AS state, CAST(0 AS DOUBLE) AS until, CAST([] AS DOUBLE[]) AS recent FROM e UNION ALL
SELECT user_id, n, seq, CASE WHEN now = 'HALF_OPEN' THEN CASE WHEN bad THEN 'OPEN' ELSE 'CLOSED' END WHEN now = 'CLOSED' AND bad AND len(kept) >= 3 THEN 'OPEN' ELSE now END,
CASE WHEN now = 'HALF_OPEN' THEN CASE WHEN bad THEN t + 3600 ELSE 0 END WHEN now = 'CLOSED' AND bad AND len(kept) >= 3 THEN t + 3600 ELSE until END,
CASE WHEN now = 'HALF_OPEN' THEN CAST([] AS DOUBLE[]) WHEN now = 'CLOSED' AND bad THEN CASE WHEN len(kept) >= 3 THEN CAST([] AS DOUBLE[]) ELSE kept END ELSE recent END
FROM (SELECT e.*, r.until, r.recent, CASE WHEN r.state = 'OPEN' AND e.t >= r.until THEN 'HALF_OPEN' ELSE r.state END AS now, list_append(list_filter(r.recent, lambda x: x >= e.t - 86400), e.t) AS kept FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, seq, state FROM r WHERE n > 0""")
def breaker_states(t):
    e = t("events").select("user_id", F.col("event_id").alias("seq"), second("ts").alias("at"), (F.col("event_type") == "error").alias("failed"))
    return L.sliding_breaker(e, "user_id", "at", "failed", 3, 86400.0, 3600.0)


@query("""WITH RECURSIVE e AS (SELECT user_id AS account, value AS v, event_type AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT DISTINCT account, CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS reserved, CAST(0 AS DOUBLE) AS spent, CAST(0 AS BIGINT) AS starts, CAST(0 AS BIGINT) AS refused FROM e UNION ALL
SELECT e.account, e.n, CASE WHEN k IN ('click', 'error') AND NOT reserved + spent + v > 200 THEN reserved + v WHEN k = 'signup' THEN greatest(0, reserved - v) WHEN k = 'purchase' THEN reserved - least(reserved, v) ELSE reserved END,
CASE WHEN k = 'purchase' THEN spent + least(reserved, v) ELSE spent END, starts + CAST(k = 'view' AS BIGINT), refused + CAST(k IN ('click', 'error') AND reserved + spent + v > 200 AS BIGINT) FROM r JOIN e ON e.account = r.account AND e.n = r.n + 1)
SELECT account, arg_max(reserved, n) AS reserved, arg_max(spent, n) AS spent, arg_max(starts, n) AS starts, false AS fenced, arg_max(refused, n) AS refused FROM r GROUP BY account""")
def budgets(t):
    kinds = F.create_map(*[F.lit(x) for p in (("click", "reserve"), ("view", "dispatch"), ("purchase", "complete"), ("signup", "refund"), ("error", "reserve")) for x in p])
    e = t("events").select(F.col("user_id").alias("account"), F.col("event_id").alias("seq"), kinds[F.col("event_type")].alias("kind"), F.col("value").alias("amount"), F.lit(0.0).alias("total"))
    return L.budget_fold(e)


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS rolling_mean FROM events""")
def rolling_means(t):
    return L.rolling_mean(t("events"), ["user_id"], "event_id", "value").select("event_id", F.round("rolling_mean", 6).alias("rolling_mean"))


@query("""WITH r AS (SELECT ['base', 'd1', 'd2'][1 + o_orderkey % 3] AS ws, 'i' || o_custkey AS id, min(o_orderkey) AS payload, 1 + o_orderkey % 3 AS rank FROM orders WHERE o_orderkey % 4 < 3 GROUP BY 1, 2, 4),
g AS (SELECT 'i' || c_custkey AS id, max(2 + c_custkey % 2) AS grave FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1)
SELECT id, workspace, payload FROM (SELECT id, arg_max(ws, rank) AS workspace, arg_max(payload, rank) AS payload, max(rank) AS rank FROM r GROUP BY id) LEFT JOIN g USING (id) WHERE grave IS NULL OR rank >= grave""")
def layers(t):
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    names = F.array(*map(F.lit, ("base", "d1", "d2")))
    rows = t("orders").where(o % 4 < 3).groupBy(F.get(names, (o % 3).cast("int")).alias("workspace"), F.concat(F.lit("i"), F.col("o_custkey").cast("string")).alias("id")).agg(F.min(o).alias("payload"))
    graves = t("customer").where(c % 3 == 0).select(F.when(c % 2 == 0, "d1").otherwise("d2").alias("namespace"), F.lit("vector").alias("role"), F.concat(F.lit("i"), c.cast("string")).alias("output_id"))
    return G.visible_rows(rows, graves, ["base", "d1", "d2"], "vector")


@query("""WITH n AS (SELECT user_id AS output, max(ts) AS seen, arg_max(event_type, ts) AS kind FROM events GROUP BY 1),
s AS (SELECT c_custkey % 50 AS unit, c_nationkey AS role, CASE WHEN seen IS NULL OR kind NOT IN ('click', 'error') AND TIMESTAMP '2024-01-31' - seen <= INTERVAL 2 DAY AND seen <= TIMESTAMP '2024-01-31' THEN 'unknown' WHEN seen > TIMESTAMP '2024-01-31' THEN 'unknown' WHEN epoch(TIMESTAMP '2024-01-31') - epoch_us(seen) / 1e6 > 172800 THEN 'stale' WHEN kind = 'click' THEN 'present' WHEN kind = 'error' THEN 'missing' ELSE 'unknown' END AS st, c_mktsegment <> 'BUILDING' AS req FROM customer LEFT JOIN n ON output = c_custkey)
SELECT unit, role, CASE WHEN NOT bool_or(req) THEN 'not_applicable' ELSE ['missing', 'unknown', 'stale', 'present'][min(list_position(['missing', 'unknown', 'stale', 'present'], st))] END AS state FROM s GROUP BY unit, role""")
def coverage_roles(t):
    expected = t("customer").select((F.col("c_custkey") % 50).alias("unit"), F.col("c_nationkey").alias("role"), F.col("c_custkey").alias("output"), (F.col("c_mktsegment") != "BUILDING").alias("required"))
    seen = t("events").select(F.col("user_id").alias("output"), second("ts").alias("observed_at"), F.when(F.col("event_type") == "click", "present").when(F.col("event_type") == "error", "missing").otherwise("odd").alias("state"))
    return G.role_states(expected, seen, F.lit("2024-01-31").cast("timestamp"), 172800.0)


@query("""SELECT o_orderkey AS record, CAST(count(l_linenumber) AS BIGINT) AS n_required, count(*) FILTER (l_suppkey % 10 <> 0) AS n_complete, count(l_linenumber) > 0 AND count(l_linenumber) = count(*) FILTER (l_suppkey % 10 <> 0) AS complete
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey, l_suppkey, l_suppkey AS l_linenumber FROM lineitem) ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def section_states(t):
    units = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("units"))
    required = t("orders").join(units, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("record"), "units")
    states = t("supplier").select(F.col("s_suppkey").alias("unit"), F.when(F.col("s_suppkey") % 10 != 0, "complete").otherwise("missing").alias("state"))
    return G.section_completeness(required, states)


@query("""SELECT c_mktsegment, x AS index_rule, y AS nearest_rule FROM (SELECT c_mktsegment, list_sort(list(c_acctbal)) AS v, count(*) AS n, v[1 + least(n - 1, CAST(floor(0.95 * n) AS BIGINT))] AS x, v[greatest(1, CAST(ceil(0.95 * n) AS BIGINT))] AS y FROM customer GROUP BY 1)""")
def percentiles(t):
    a = G.percentile_index(t("customer"), ["c_mktsegment"], "c_acctbal", 0.95).withColumnRenamed("percentile", "index_rule")
    return a.join(G.percentile_index(t("customer"), ["c_mktsegment"], "c_acctbal", 0.95, True).withColumnRenamed("percentile", "nearest_rule"), "c_mktsegment")


def served(t):
    return t("lineitem").select(F.col("l_orderkey").alias("qid"), (F.col("l_linenumber") - 1).alias("rank"), F.col("l_suppkey").alias("key"), "l_quantity", "l_partkey")


def gold(t):
    return t("lineitem").where("l_partkey % 4 = 0 OR l_linenumber = 2").select(F.col("l_orderkey").alias("qid"), F.col("l_suppkey").alias("key"))


@query("""WITH s AS (SELECT l_orderkey AS qid, l_linenumber - 1 AS rank, l_suppkey AS key FROM lineitem), g AS (SELECT DISTINCT l_orderkey AS qid, l_suppkey AS key FROM lineitem WHERE l_partkey % 4 = 0 OR l_linenumber = 2)
SELECT qid, round(count(*) FILTER (EXISTS (SELECT 1 FROM s WHERE s.qid = g.qid AND s.key = g.key AND s.rank < 3)) / CAST(count(*) AS DOUBLE), 9) AS recall FROM g GROUP BY qid""")
def recalls(t):
    return E.recall_at(served(t), gold(t), 3, False).select("qid", F.round("recall", 9).alias("recall"))


@query("""SELECT l_orderkey AS qid, round(CAST(count(DISTINCT l_suppkey) FILTER (l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 6 <> 0)) AS DOUBLE) / count(DISTINCT l_suppkey), 9) AS rate FROM lineitem GROUP BY 1""")
def hallucinations(t):
    legal = t("lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_suppkey").alias("key")).where("key % 6 <> 0")
    return E.hallucinated(served(t), legal).select("qid", F.round("rate", 9).alias("rate"))


@query("""SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, round(coalesce(stddev_samp(l_quantity), 0), 6) AS sd, count(*) AS n, 2 * count(*) FILTER (l_quantity > 25) >= count(*) AS majority FROM lineitem GROUP BY 1, 2""")
def judge_aggregates(t):
    by = ["l_returnflag", "l_linestatus"]
    rows = t("lineitem").withColumn("vote", F.col("l_quantity") > 25)
    m = E.seed_mean(rows, by, "l_quantity").withColumns({"mean": F.round("mean", 6), "sd": F.round("sd", 6)})
    return m.join(E.majority(rows, by, "vote"), by)


@query("""WITH r AS (SELECT user_id, CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' ELSE 'tie' END AS v, CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS w FROM events),
c AS (SELECT user_id, count(*) FILTER (v = 'a') AS n_a, count(*) FILTER (v = 'b') AS n_b, count(*) FILTER (v = 'tie') AS n_tie, CAST(coalesce(sum(CASE v WHEN 'a' THEN w WHEN 'b' THEN -w ELSE 0 END), 0) AS BIGINT) AS balance FROM r GROUP BY 1)
SELECT *, CASE WHEN n_a > n_b THEN 'a' WHEN n_b > n_a THEN 'b' WHEN balance > 0 THEN 'a' WHEN balance < 0 THEN 'b' ELSE 'tie' END AS winner FROM c""")
def tallies(t):
    kind, c = F.col("event_type"), F.col("event_id") % 3
    rows = t("events").select("user_id", F.when(kind == "click", "a").when(kind == "view", "b").otherwise("tie").alias("verdict"), F.when(c == 0, "high").when(c == 1, "med").otherwise("low").alias("confidence"))
    return E.pairwise_tally(rows, ["user_id"])


@query("""SELECT o_orderkey AS qid, round(coalesce((SELECT avg(l_quantity) / 100 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 5), 0), 6) AS precision FROM orders""")
def precisions(t):
    judged = t("lineitem").where("l_quantity > 5").select(F.col("l_orderkey").alias("qid"), F.col("l_quantity").alias("ims"))
    return E.macro_precision(judged, t("orders").select(F.col("o_orderkey").alias("qid"))).select("qid", F.round("precision", 6).alias("precision"))


def runs(t):
    return t("events").groupBy((F.col("event_id") % 4).alias("run"), F.col("user_id").alias("qid")).agg(F.avg("value").alias("value"))


@query("""WITH r AS (SELECT event_id % 4 AS run, user_id AS qid, avg(value) AS value FROM events GROUP BY 1, 2), q AS (SELECT stddev_samp(value) AS sd FROM r GROUP BY qid), m AS (SELECT avg(value) AS m FROM r GROUP BY run)
SELECT round((SELECT avg(sd) FROM q), 6) AS mean_qid_sd, round((SELECT stddev_samp(m) FROM m), 6) AS run_sd, round((SELECT max(m) - min(m) FROM m), 6) AS run_range""")
def noise_floors(t):
    return E.noise_floor(runs(t)).select(*[F.round(c, 6).alias(c) for c in ("mean_qid_sd", "run_sd", "run_range")])


@query("""WITH r AS (SELECT user_id AS qid, avg(value) / 100 AS a FROM events WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT user_id AS qid, avg(value) / 50 AS b FROM events WHERE event_id % 2 = 1 GROUP BY 1)
SELECT qid, round(CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END, 6) AS headline FROM r JOIN n USING (qid)""")
def headlines(t):
    e = t("events")
    a = e.where("event_id % 2 = 0").groupBy(F.col("user_id").alias("qid")).agg((F.avg("value") / 100).alias("recall"))
    b = e.where("event_id % 2 = 1").groupBy(F.col("user_id").alias("qid")).agg((F.avg("value") / 50).alias("nugget_recall"))
    return E.headline(a, b).select("qid", F.round("headline", 6).alias("headline"))


def pairs(t):
    e = t("events")
    a = e.groupBy("event_type", "user_id").agg(F.avg(F.when(F.col("event_id") % 2 == 0, F.col("value"))).alias("a"), F.avg(F.when(F.col("event_id") % 2 == 1, F.col("value"))).alias("b"))
    return a.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("event_type").alias("metric"), F.col("user_id").alias("qid"), "a", "b")


@query()
def metric_comparisons(t):
    return E.compare_metrics(pairs(t), ["error"], rounds=2000)


@query("""WITH p AS (SELECT event_type AS metric, user_id, avg(value) FILTER (event_id % 2 = 0) AS a, avg(value) FILTER (event_id % 2 = 1) AS b FROM events GROUP BY 1, 2),
d AS (SELECT metric, b - a AS d, sum(b - a) OVER (PARTITION BY metric) AS s, count(*) OVER (PARTITION BY metric) AS n FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT metric, round(min((s - d) / (n - 1)), 6) AS low, round(max((s - d) / (n - 1)), 6) AS high, sign(min((s - d) / (n - 1))) = sign(max((s - d) / (n - 1))) AS stable FROM d WHERE n > 1 GROUP BY metric""")
def jackknives(t):
    return E.jackknife(pairs(t)).select("metric", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "stable")


@query("""WITH v AS (SELECT event_type AS metric, user_id AS qid, avg(value) AS value FROM events GROUP BY 1, 2), u AS (SELECT count(DISTINCT user_id) AS want FROM events WHERE event_type = 'view'), s AS (SELECT metric, avg(value) AS m, count(*) AS n FROM v WHERE qid IN (SELECT user_id FROM events WHERE event_type = 'view') GROUP BY 1)
SELECT r.metric, n IS NOT NULL AND n >= want AND NOT m < 5 AND NOT m > 60 AS passed, CASE WHEN n IS NULL OR n < want THEN 'missing' WHEN m < 5 THEN 'below' WHEN m > 60 THEN 'above' ELSE '' END AS reason
FROM (SELECT unnest(['click', 'error', 'view', 'absent']) AS metric) r CROSS JOIN u LEFT JOIN s ON s.metric = r.metric""")
def release_gates(t):
    spark = t("events").sparkSession
    values = t("events").groupBy(F.col("event_type").alias("metric"), F.col("user_id").alias("qid")).agg(F.avg("value").alias("value"))
    rules = spark.createDataFrame([(m, 5.0, 60.0) for m in ("click", "error", "view", "absent")], "metric string, low double, high double")
    return E.gates(values, rules, t("events").where("event_type = 'view'").select(F.col("user_id").alias("qid"))).select("metric", F.coalesce("passed", F.lit(False)).alias("passed"), "reason")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('0:' || doc_id), doc_id) AS n FROM documents) WHERE n <= 25")
def stratified(t):
    return E.stratified_sample(t("documents").select("doc_id", "lang"), "lang", "doc_id", 25)
