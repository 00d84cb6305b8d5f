"""Queries of commands and registrations that depend on those before them: users of events are units, some of their commands come twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import adoption as A
from lectern.operators import commands as C
from lectern.operators.registration import registered
from lectern.plans.registry import query

_ACTION = f"CASE WHEN event_id % 211 = 7 THEN 'cancel' WHEN event_id % 53 = 9 THEN 'quarantine' WHEN event_id % 23 = 5 THEN 'clear_quarantine' WHEN event_id % 19 = 3 THEN 'reset_reducer' WHEN nth = 1 THEN 'enqueue' WHEN nth % 7 = 2 THEN 'claim' WHEN nth % 7 = 3 AND event_id % 3 = 0 THEN 'fail' WHEN nth % 7 = 3 AND event_id % 3 = 1 THEN 'begin_retirement' WHEN nth % 7 = 4 THEN 'seal_namespace' WHEN nth % 7 = 5 THEN 'complete' WHEN nth % 7 = 6 AND event_id % 2 = 0 THEN 'claim_publication' WHEN nth % 7 = 0 AND event_id % 2 = 0 THEN 'publish_derivation' WHEN nth % 7 = 1 THEN 'rebase' ELSE element_at(array({', '.join(map(repr, C.ACTIONS))}), CAST(event_id % 19 + 1 AS INT)) END"
# a claim brings a fresh token, its place in the unit's log; others bring the token of the last claim, or a stale one
_LOG = f"""SELECT event_id AS operation_id, user_id AS unit, event_id * 2 AS seq, action, CASE WHEN action IN ('claim', 'rebase') THEN nth WHEN event_id % 29 = 11 THEN nth - 9 ELSE last_claim END AS token, event_type AS payload FROM (SELECT *, max(CASE WHEN action IN ('claim', 'rebase') THEN nth END) OVER (PARTITION BY user_id ORDER BY event_id) AS last_claim FROM (SELECT *, {_ACTION} AS action FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events)))"""
_DUCK_LOG = _LOG.replace("element_at(array(", "list_extract(list_value(")


def _rules() -> str:
    """The moves as rows (action, phase, then), with whether the action claims, is owned, fails or needs a unit that is clear."""
    flags = ", ".join(f"('{a}', '{p}', '{q}', {a in C.CLAIMS}, {a in C.OWNED}, {a in C.FAILURES}, {a in C.NEED_CLEAR})" for a, moves in C.MOVES.items() for p, q in moves.items())
    return f"(VALUES {flags}) AS rules(action, phase, then_, claims, owned, fails, clear)"


@query(f"""WITH RECURSIVE l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY seq) AS k FROM ({_DUCK_LOG})), r AS MATERIALIZED (SELECT * FROM {_rules()}),
s AS (SELECT unit, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS operation_id, CAST(NULL AS BIGINT) AS seq, false AS accepted, 'absent' AS phase, 0 AS failures, false AS quarantined, CAST(NULL AS BIGINT) AS holder FROM (SELECT DISTINCT unit FROM l)
UNION ALL SELECT l.unit, l.k, l.operation_id, l.seq, r.action IS NOT NULL AS ok, coalesce(r.then_, s.phase), CASE WHEN r.fails THEN least(s.failures + 1, {C.PARKED}) WHEN r.action = 'reset_reducer' OR (r.action = 'complete' AND s.phase = 'sealed') THEN 0 ELSE s.failures END,
 CASE WHEN r.action = 'quarantine' THEN true WHEN r.action = 'clear_quarantine' THEN false ELSE s.quarantined END, CASE WHEN r.claims THEN l.token ELSE s.holder END
 FROM s JOIN l ON l.unit = s.unit AND l.k = s.k + 1 LEFT JOIN r ON r.action = l.action AND r.phase = s.phase AND (NOT r.owned OR l.token = s.holder) AND NOT (r.clear AND s.quarantined) AND NOT (r.claims AND s.failures >= {C.PARKED}))
SELECT * EXCLUDE (k) FROM s WHERE k > 0""")
def commands_applied(t):
    log = t("events").sparkSession.sql(_LOG.replace("FROM events", "FROM {events}"), events=t("events"))
    again = log.where("operation_id % 10 = 0").withColumn("seq", F.col("seq") + 1)  # sent twice
    return C.commands_reduced(log.unionByName(again))


@query()  # each decision rests on those before it: tested against a loop over candidates
def batches_registered(t):
    k, o = F.col("p_partkey"), F.col("o_orderkey")

    def identity(x, n: int):
        return [F.when(x % 3 > 0, F.concat(F.lit("10.1/"), x % n)).alias("doi"), F.when(x % 4 > 1, F.concat(F.lit("2001."), x % (n + 7))).alias("arxiv"), F.when(x % 8 > 5, F.concat(F.lit("v"), x % 2 + 1)).alias("version"), F.concat(F.lit("title "), x % (n * 2 + 1)).alias("title")]

    records = t("part").select(F.concat(F.lit("r"), k).alias("record"), k.alias("ord"), *identity(k, 5000))
    candidates = t("orders").select(F.concat(F.lit("c"), o).alias("id"), o.alias("pos"), *identity(o, 7000), (F.col("o_custkey") % 11 > 0).alias("valid"))
    aliases = t("supplier").select(F.col("s_suppkey").alias("ord"), *identity(F.col("s_suppkey") + 4000, 7000), F.concat(F.lit("r"), F.col("s_suppkey")).alias("record"))
    return registered(candidates, records, aliases)


# records with identifiers, some absorbed or merging; claims of values that records and other claims want too
_HOLDERS = """SELECT 'r' || p_partkey AS key, p_partkey AS ord, CASE p_partkey % 5 WHEN 0 THEN 'core' WHEN 1 THEN 'web, ads' WHEN 2 THEN 'local' ELSE NULL END AS source, CASE WHEN p_partkey % 13 = 6 AND p_partkey > 1 THEN 'r' || (p_partkey - 1) END AS canonical, p_partkey % 17 = 4 AS blocked,
CASE WHEN p_partkey % 3 = 0 THEN 'https://doi.org/10.1000/A' || (p_partkey % 1501) ELSE '' END AS doi, CASE WHEN p_partkey % 4 = 1 THEN 'arXiv:2001.' || (10000 + p_partkey % 907) || 'v2' END AS arxiv_id, CASE WHEN p_partkey % 5 = 3 THEN '00' || (p_partkey % 701 + 1) END AS inspire_record_id, CASE WHEN p_partkey % 6 = 2 THEN 'x' || (p_partkey % 211) END AS paper_id FROM part"""
_WANTS = """SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey * 8 + l_linenumber AS pos, CASE WHEN l_orderkey % 97 = 5 THEN 'q' ELSE 'r' END || l_partkey AS key, element_at(array('doi', 'arxiv_id', 'inspire_record_id', 'paper_id'), CAST(l_linenumber % 4 + 1 AS INT)) AS name,
CASE WHEN l_orderkey % 31 = 3 THEN ' ' WHEN l_linenumber % 4 = 0 THEN '10.1000/a' || (l_orderkey % 3001) WHEN l_linenumber % 4 = 1 THEN '2001.' || (10000 + l_orderkey % 3001) WHEN l_linenumber % 4 = 2 THEN '0' || (l_orderkey % 3001) ELSE 'x' || (l_orderkey % 401) END AS value, l_orderkey % 7 = 2 AS completing FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL)"""
_KEPT = "SELECT element_at(array('doi', 'arxiv_id'), CAST(c_custkey % 2 + 1 AS INT)) AS name, CASE c_custkey % 2 WHEN 0 THEN '10.1000/a' || c_custkey ELSE '2001.' || (10000 + c_custkey) END AS token, 'r' || (c_custkey % 50) AS key FROM customer WHERE c_custkey % 20 < 2"
_SPACE = "CASE source WHEN 'core' THEN 'core:work' WHEN 'web, ads' THEN 'ads:bibcode' ELSE source END"
_TOKEN = f"CASE name WHEN 'doi' THEN lower(replace(trim(value), 'https://doi.org/', '')) WHEN 'arxiv_id' THEN regexp_replace(replace(trim(value), 'arXiv:', ''), 'v2$', '') WHEN 'inspire_record_id' THEN ltrim(trim(value), '0') ELSE CASE WHEN trim(value) <> '' AND source IS NOT NULL THEN {_SPACE} || ':' || trim(value) ELSE '' END END"
_ADOPTED = f"""r AS MATERIALIZED ({_HOLDERS}), held AS MATERIALIZED (SELECT *, {_TOKEN} AS token FROM (SELECT key, ord, coalesce(canonical, key) AS stands, source, unnest(['doi', 'arxiv_id', 'inspire_record_id', 'paper_id']) AS name, unnest([doi, arxiv_id, inspire_record_id, paper_id]) AS value FROM r) WHERE value <> ''),
o AS (SELECT name, token, arg_min(stands, ord) AS owner FROM held WHERE token <> '' GROUP BY 1, 2), kept AS ({_KEPT}),
c AS MATERIALIZED (SELECT w.*, r.key IS NOT NULL AS there, r.canonical IS NOT NULL AS absorbed, r.blocked, coalesce({_TOKEN}, '') AS token FROM ({_WANTS}) w LEFT JOIN r ON r.key = w.key),
e AS MATERIALIZED (SELECT c.*, m.token AS mine, o.owner, CASE WHEN NOT there THEN 'refused-missing' WHEN absorbed OR (blocked AND NOT completing) THEN 'refused-blocked' WHEN c.token = '' THEN 'refused-empty' WHEN EXISTS (SELECT 1 FROM kept WHERE kept.name = c.name AND kept.token = c.token AND kept.key <> c.key) THEN 'refused-reserved' WHEN o.owner <> c.key THEN 'refused-held-by-other' WHEN m.token = c.token THEN 'already-mine' END AS early
 FROM c LEFT JOIN held m ON m.key = c.key AND m.name = c.name LEFT JOIN o ON o.name = c.name AND o.token = c.token),
g AS (SELECT name, key, token, pos, pos = min(pos) OVER (PARTITION BY name, key) AND pos = min(pos) OVER (PARTITION BY name, token) AS won FROM e WHERE early IS NULL AND mine IS NULL
UNION ALL SELECT name, key, token, pos, pos = min(pos) OVER (PARTITION BY name, key) AND pos = min(pos) OVER (PARTITION BY name, token) FROM (SELECT *, bool_or(won) OVER (PARTITION BY name, key) AS k, bool_or(won) OVER (PARTITION BY name, token) AS t FROM g) WHERE NOT k AND NOT t),
w AS MATERIALIZED (SELECT * FROM g WHERE won), d AS (SELECT e.*, a.key AS to_, CASE WHEN early IS NOT NULL THEN early WHEN a.key <> e.key AND a.pos < e.pos THEN 'refused-held-by-other' WHEN mine IS NOT NULL THEN 'refused-existing' WHEN b.pos = e.pos THEN 'adopted' WHEN b.token = e.token THEN 'already-mine' ELSE 'refused-existing' END AS outcome
 FROM e LEFT JOIN w a ON a.name = e.name AND a.token = e.token LEFT JOIN w b ON b.name = e.name AND b.key = e.key)""".replace("element_at(array(", "list_extract(list_value(")


def _sides(t):
    spark = t("part").sparkSession
    return spark.sql(_WANTS.replace("FROM lineitem", "FROM {lineitem}"), lineitem=t("lineitem")), spark.sql(_HOLDERS.replace("FROM part", "FROM {part}"), part=t("part")), spark.sql(_KEPT.replace("FROM customer", "FROM {customer}"), customer=t("customer"))


@query(f"WITH RECURSIVE {_ADOPTED} SELECT id, pos, key, name, value, token, outcome, CASE WHEN outcome = 'refused-held-by-other' THEN coalesce(owner, to_) END AS holder FROM d")
def identifiers_adopted(t):
    return A.adopted(*_sides(t))


@query(f"""WITH RECURSIVE {_ADOPTED}, p AS (SELECT key, {', '.join(f"max(value) FILTER (name = '{n}') AS {n}" for n in A.NAMES)} FROM d WHERE outcome = 'adopted' GROUP BY key) SELECT r.key, {', '.join(f'coalesce(p.{n}, r.{n}) AS {n}' for n in A.NAMES)} FROM r LEFT JOIN p ON p.key = r.key""")
def records_after_adoption(t):
    claims, records, kept = _sides(t)
    return A.adopted_records(records, A.adopted(claims, records, kept)).select("key", *A.NAMES)


# stubs without a DOI, holders, some merging; absorbed records stand under one that holds a DOI
_STUBS = "SELECT p_partkey AS key, p_partkey AS ord, CASE WHEN p_partkey % 5 > 0 THEN '10.1000/' || (p_partkey % 997) ELSE '' END AS doi, CASE WHEN p_partkey % 20 = 7 AND p_partkey > 1 THEN p_partkey - 1 END AS canonical, p_partkey % 19 = 8 AS merging, CASE WHEN p_partkey % 4 > 1 THEN p_brand END AS venue FROM part"
_FOUND = "SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey * 8 + l_linenumber AS pos, CASE WHEN l_orderkey % 83 = 1 THEN -l_partkey ELSE l_partkey END AS key, CASE WHEN l_orderkey % 29 = 4 THEN NULL ELSE '10.1000/' || (l_orderkey % 5003) END AS doi FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL)"
_RESOLVED = f"""r AS MATERIALIZED ({_STUBS}), o AS (SELECT doi, arg_min(coalesce(canonical, key), ord) AS owner FROM r WHERE doi <> '' GROUP BY doi),
c AS (SELECT f.id, f.pos, f.key, coalesce(f.doi, '') AS doi, r.key IS NULL AS missing, r.canonical, r.merging, r.doi AS own, o.owner, coalesce(h.merging, false) AND o.owner <> f.key AS waits FROM ({_FOUND}) f LEFT JOIN r ON r.key = f.key LEFT JOIN o ON o.doi = f.doi LEFT JOIN r h ON h.key = o.owner),
a AS MATERIALIZED (SELECT *, NOT missing AND canonical IS NULL AND NOT merging AND own = '' AND doi <> '' AND NOT coalesce(waits, false) AS acts FROM c), f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) AS n FROM a WHERE acts), s AS (SELECT key, pos, doi, coalesce(owner, first_value(key) OVER (PARTITION BY doi, owner ORDER BY pos)) AS to_ FROM f WHERE n = 1),
d AS MATERIALIZED (SELECT a.*, to_, CASE WHEN missing THEN 'no_paper' WHEN a.canonical IS NOT NULL THEN 'alias' WHEN a.merging THEN 'merge_waiting' WHEN a.own <> '' THEN 'has_doi' WHEN a.pos > s.pos AND to_ = a.key THEN 'has_doi' WHEN a.pos > s.pos THEN 'alias' WHEN a.doi = '' THEN 'no_paper' WHEN NOT a.acts THEN 'merge_waiting' WHEN to_ = a.key THEN 'set' ELSE 'collision' END AS outcome, s.pos AS at_, s.doi AS set_ FROM a LEFT JOIN s ON s.key = a.key)"""


def _found(t):
    spark = t("part").sparkSession
    return spark.sql(_FOUND.replace("FROM lineitem", "FROM {lineitem}"), lineitem=t("lineitem")), spark.sql(_STUBS.replace("FROM part", "FROM {part}"), part=t("part"))


@query(f"""WITH {_RESOLVED} SELECT id, pos, key, doi, outcome, CASE WHEN missing OR merging AND canonical IS NULL THEN '' WHEN outcome = 'alias' THEN CAST(coalesce(canonical, to_) AS VARCHAR) WHEN outcome = 'has_doi' THEN CASE WHEN own <> '' THEN own ELSE set_ END WHEN outcome = 'no_paper' THEN 'empty doi' WHEN outcome = 'merge_waiting' THEN CAST(owner AS VARCHAR) WHEN outcome = 'set' THEN doi ELSE CAST(to_ AS VARCHAR) END AS detail FROM d""")
def stubs_resolved(t):
    return A.dois_resolved(*_found(t))


@query(f"""WITH {_RESOLVED}, b AS (SELECT d.to_ AS key, arg_min(r.venue, d.pos) FILTER (r.venue IS NOT NULL) AS venue FROM d JOIN r ON r.key = d.key WHERE outcome = 'collision' GROUP BY 1)
SELECT r.key, coalesce(p.doi, r.doi) AS doi, coalesce(g.to_, r.canonical) AS canonical, coalesce(r.venue, b.venue) AS venue FROM r LEFT JOIN (SELECT key, doi FROM d WHERE outcome = 'set') p ON p.key = r.key LEFT JOIN (SELECT key, to_ FROM d WHERE outcome = 'collision') g ON g.key = r.key LEFT JOIN b ON b.key = r.key""")
def records_after_resolution(t):
    claims, records = _found(t)
    return A.resolved_records(records, A.dois_resolved(claims, records), ("venue",)).select("key", "doi", "canonical", "venue")
