"""Queries of paced calls and breakers on probation: users of events, in a few groups, call; an error is a call that ends badly."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import pacing as P
from lectern.plans.registry import query

_POLICY = P.Policy(((2, 900.0), (5, 7200.0)), concurrency=2, quiet=1800.0, cluster=2, cluster_seconds=3600.0)
_WAYS = {"send": "true", "response": "event_id % 22 = 3", "result": "event_id % 251 <> 9", "cool": "event_id % 101 = 17"}
_AT = "epoch(ts) + CASE kind WHEN 'response' THEN (event_id * 37 % 1500) / 2 WHEN 'result' THEN event_id * 37 % 1500 + 1 ELSE 0 END"
_WINDOWS = [(f"x{i}", n, s) for i, (n, s) in enumerate(_POLICY.windows)]


@query(f"""WITH RECURSIVE k AS (SELECT unnest({list(_WAYS)}) AS kind, unnest(range({len(_WAYS)})) AS i), l AS (SELECT user_id % 23 AS scope, event_id * 4 + i AS seq, {_AT} AS at_, kind, CASE WHEN kind <> 'cool' THEN event_id END AS ticket, kind IN ('response', 'result') AND event_id % 11 = 3 AS many, kind = 'result' AND event_type = 'error' AS late FROM events, k
 WHERE {" OR ".join(f"(kind = '{k}' AND {test})" for k, test in _WAYS.items())}),
e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY at_, seq) AS n FROM l),
r AS (SELECT DISTINCT scope, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, 'ok' AS outcome, CAST(0 AS DOUBLE) AS wait, CAST([] AS DOUBLE[]) AS sends, CAST([] AS BIGINT[]) AS active, CAST([] AS DOUBLE[]) AS timeouts, CAST(NULL AS DOUBLE) AS until FROM e
UNION ALL SELECT scope, n, seq, outcome, CASE outcome WHEN 'cooldown' THEN until_ - at_ WHEN 'window' THEN wait_ ELSE 0 END, CASE WHEN outcome = 'sent' THEN list_append(sends_, at_) ELSE sends_ END,
 CASE WHEN outcome = 'sent' THEN list_append(active, ticket) WHEN known AND kind = 'result' THEN list_filter(active, lambda x: x <> ticket) ELSE active END, timeouts_,
 CASE WHEN known AND CASE kind WHEN 'cool' THEN until_ IS NULL WHEN 'send' THEN false ELSE many OR (late AND (until_ IS NOT NULL OR len(timeouts_) >= {_POLICY.cluster})) END THEN at_ + {_POLICY.quiet} ELSE until_ END
FROM (SELECT *, CASE WHEN NOT known THEN 'unknown' WHEN kind <> 'send' THEN 'ok' WHEN until_ IS NOT NULL THEN 'cooldown' WHEN len(active) >= {_POLICY.concurrency} THEN 'concurrency' WHEN wait_ IS NOT NULL THEN 'window' ELSE 'sent' END AS outcome FROM (
 SELECT *, greatest({", ".join(f"CASE WHEN len({x}) >= {n} THEN {x}[len({x}) - {n - 1}] + {s} - at_ END" for x, n, s in _WINDOWS)}) AS wait_, CASE WHEN known AND kind = 'result' AND late AND NOT many THEN list_append(kept, at_) ELSE kept END AS timeouts_ FROM (
  SELECT *, CASE WHEN over THEN NULL ELSE until END AS until_, CASE WHEN over THEN [] WHEN looks THEN list_filter(timeouts, lambda x: x > at_ - {_POLICY.cluster_seconds}) ELSE timeouts END AS kept, {", ".join(f"list_filter(sends_, lambda x: x > at_ - {s}) AS {x}" for x, _, s in _WINDOWS)} FROM (
   SELECT *, CASE WHEN looks THEN list_filter(sends, lambda x: x > at_ - {max(s for _, _, s in _WINDOWS)}) ELSE sends END AS sends_, looks AND until IS NOT NULL AND at_ >= until AS over FROM (
    SELECT *, known AND kind <> 'response' AS looks FROM (SELECT e.*, r.sends, r.active, r.timeouts, r.until, e.kind IN ('send', 'cool') OR list_contains(r.active, e.ticket) AS known FROM r JOIN e ON e.scope = r.scope AND e.n = r.n + 1)))))))
SELECT scope, seq, outcome, round(wait, 6) AS wait, len(active) AS in_flight, until AS cooling_until FROM r WHERE n > 0""")
def calls_paced(t):
    e = t("events").withColumn("_t", F.col("ts").cast("timestamp").cast("double"))
    x, hurt = F.col("event_id"), F.col("event_type") == "error"
    many = F.when(x % 11 == 3, P.TOO_MANY)
    none, no = F.lit(None).cast("int"), F.lit(False)
    ways = [
        ("send", F.lit(0), none, no), ("response", (x * 37 % 1500) / 2, many, no),
        ("result", x * 37 % 1500 + 1, F.coalesce(many, F.lit(200)), hurt), ("cool", F.lit(0), none, no),
    ]
    rows = F.array(*[F.struct((x * 4 + i).alias("seq"), (F.col("_t") + after).alias("at"), F.lit(kind).alias("kind"), F.when(F.lit(kind != "cool"), x).alias("ticket"), status.alias("status"), late.alias("timed_out"), F.expr(_WAYS[kind]).alias("there")) for i, (kind, after, status, late) in enumerate(ways)])
    log = e.select((F.col("user_id") % 23).alias("scope"), F.inline(rows)).where("there")
    return P.paced(log, _POLICY).withColumn("wait", F.round("wait", 6))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id % 23 AS backend, event_id AS seq, epoch(ts) AS at_, event_type = 'error' OR event_id % 40 < 9 AS bad, row_number() OVER (PARTITION BY user_id % 23 ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT DISTINCT backend, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, 'called' AS decision, 0 AS fails, CAST(NULL AS DOUBLE) AS open_until FROM e
UNION ALL SELECT backend, n, seq, decision, CASE WHEN decision = 'skipped' THEN fails WHEN bad THEN fails + 1 ELSE 0 END, CASE WHEN decision = 'skipped' THEN until WHEN bad AND (until IS NOT NULL OR fails + 1 >= 2) THEN at_ + 7200 END
 FROM (SELECT e.*, r.fails, r.open_until AS until, CASE WHEN r.open_until IS NULL THEN 'called' WHEN e.at_ < r.open_until THEN 'skipped' ELSE 'probed' END AS decision FROM r JOIN e ON e.backend = r.backend AND e.n = r.n + 1))
SELECT * EXCLUDE (n) FROM r WHERE n > 0""")
def breakers_on_probation(t):
    calls = t("events").select((F.col("user_id") % 23).alias("backend"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").cast("double").alias("at"), ((F.col("event_type") == "error") | (F.col("event_id") % 40 < 9)).alias("degraded"))
    return P.probation_breaker(calls, trips=2, cooldown=7200.0)
