"""Queries of the catalog's relations, reports and repairs.

A table that a query needs is said once, in expressions that Spark and DuckDB read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import imports as I
from lectern.operators import ledgers as L
from lectern.operators import records as R
from lectern.plans.registry import query


class Said:
    """A table over one of the standard tables: a DataFrame, and the same as SQL."""

    def __init__(self, base: str, columns: dict[str, str], where: str = "true"):
        self.base, self.columns, self.where = base, columns, where

    def __call__(self, t: Callable[[str], DataFrame]) -> DataFrame:
        return t(self.base).where(self.where).select(*[F.expr(e).alias(c) for c, e in self.columns.items()])

    def __str__(self) -> str:
        return f"(SELECT {', '.join(f'{e} AS {c}' for c, e in self.columns.items())} FROM {self.base} WHERE {self.where})"


# Scans


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey % 3 = 0)")
def batch_rows(t):
    wanted = t("customer").where("c_nationkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return R.batch_scan(t("orders").select("o_orderkey", "o_custkey"), wanted, "o_custkey")


_RECORDS = Said("customer", {
    "key": "c_custkey",
    "download_status": "CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN 'failed' WHEN c_custkey % 5 = 1 THEN 'ok' WHEN c_custkey % 5 = 2 THEN 'metadata_only' WHEN c_custkey % 5 = 3 THEN 'extract_failed' END",
    "added_at": "CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment || c_nationkey END",
    "doi": "CASE WHEN c_custkey % 3 = 0 THEN ' ' WHEN c_custkey % 3 = 1 THEN '10.1/' || c_custkey END",
    "arxiv_id": "CASE WHEN c_custkey % 4 = 0 THEN '2001.' || c_custkey ELSE '' END",
    "title": "CASE WHEN c_custkey % 6 <> 5 THEN c_name ELSE '' END",
    "has_md": "c_custkey % 2 = 0", "has_txt": "c_custkey % 13 < 4",
    "year": "CASE WHEN c_custkey % 9 <> 0 THEN 1990 + c_custkey % 30 END",
    "citation_count": "CASE WHEN c_custkey % 8 <> 0 THEN c_custkey % 40 END",
    "extract_path": "CASE WHEN c_custkey % 2 = 0 THEN 'md/' || c_custkey WHEN c_custkey % 3 = 0 THEN '' END",
})


@query(f"SELECT key FROM {_RECORDS} WHERE download_status = 'failed'")
def failed_keys(t):
    return R.status_scan(_RECORDS(t), "failed")


@query(f"SELECT key, year FROM {_RECORDS}")
def ordered_records(t):
    return R.ordered_scan(_RECORDS(t)).select("key", "year")


@query("SELECT CAST(l_linenumber AS BIGINT) AS line, 's' || l_suppkey AS supplier, CAST(NULL AS VARCHAR) AS note FROM lineitem")
def restored_lines(t):
    row = F.to_json(F.struct(F.col("l_linenumber").alias("line"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("supplier"), F.lit(1).alias("unknown")))
    batches = t("lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("["), F.array_join(F.collect_list(row), ","), F.lit("]")).alias("rows"))
    return R.restored(batches, "rows", "line BIGINT, supplier STRING, note STRING")


@query(f"SELECT key, citation_count AS citations FROM {_RECORDS} WHERE citation_count IS NOT NULL")
def citation_maps(t):
    return R.citation_counts(_RECORDS(t))


@query("SELECT coalesce(max(o_orderkey), 0) AS last_id, CAST(coalesce(sum(o_custkey), 0) AS BIGINT) AS bytes FROM orders UNION ALL SELECT 0, 0")
def object_totals(t):
    o = t("orders")
    return R.size_totals(o, "o_orderkey", "o_custkey").unionByName(R.size_totals(o.limit(0), "o_orderkey", "o_custkey"))


@query(f"""SELECT key, doi, year, CASE WHEN coalesce(extract_path, '') <> '' THEN extract_path END AS text_path,
CASE WHEN coalesce(extract_path, '') <> '' THEN NULL WHEN download_status = 'extract_failed' THEN 'extract_failed' WHEN download_status = 'failed' THEN 'download_failed' WHEN download_status = 'metadata_only' THEN 'metadata_only' ELSE 'pending' END AS text_status FROM {_RECORDS}""")
def minimal_records(t):
    rows = _RECORDS(t).withColumns({"authors": F.array().cast("array<string>"), "venue": F.lit(""), "abstract": F.lit("")})
    return R.minimal_record(rows).select("key", "doi", "year", "text_path", "text_status")


@query("SELECT c_custkey AS key, c_custkey % 2 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 5 = 1 AND c_custkey % 7 <> 0 AND c_nationkey % 4 = 0 AS eligible FROM customer")
def eligible_records(t):
    c = F.col("c_custkey")
    ok = R.eligible_record(F.when(c % 2 == 0, "rejected"), F.when(c % 3 == 0, "merge"), F.when(c % 7 != 0, False), F.when(c % 5 == 1, "canonical").when(c % 5 == 2, "alias"), F.when(c % 7 == 0, "x").when(c % 11 == 0, ""), F.when(F.col("c_nationkey") % 4 < 2, F.col("c_nationkey") % 4 == 0))
    return t("customer").select(c.alias("key"), ok.alias("eligible"))


# Joins


@query("SELECT o_orderkey AS parent_unit_id, o_custkey % 5 AS inventory_revision, o_orderstatus AS mode FROM orders WHERE o_custkey % 5 = o_orderkey % 3")
def inventories_now(t):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    heads = t("orders").select(o.alias("parent_unit_id"), (o % 3).alias("inventory_revision"))
    return R.current_inventories(heads, t("orders").select(o.alias("parent_unit_id"), (c % 5).alias("inventory_revision"), F.col("o_orderstatus").alias("mode")))


@query(f"SELECT key, doi FROM {_RECORDS} WHERE key NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def records_without_units(t):
    return R.unregistered_records(_RECORDS(t).select("key", "doi"), t("orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("record_key")))


_GENERATIONS = Said("nation", {"generation_id": "n_nationkey", "state": "CASE WHEN n_nationkey % 3 = 0 THEN 'active' WHEN n_nationkey % 3 = 1 THEN 'candidate' ELSE 'retired' END", "manifest_revision": "n_regionkey", "source_manifest_revision": "n_nationkey % 5", "retrieval_contract": "CASE WHEN n_nationkey % 4 = 0 THEN 'e1' END"})
_SELECTIONS = Said("customer", {"unit_id": "c_custkey", "derivation_id": "c_custkey % 700", "generation_id": "c_nationkey"})
_DERIVATIONS = Said("customer", {"derivation_id": "c_custkey", "receipt_id": "'q' || c_custkey % 900"}, "c_custkey % 5 <> 0")
_RECEIPTS = Said("customer", {"receipt_id": "'q' || c_custkey", "receipt": "c_mktsegment || c_custkey", "namespace": "'n' || c_custkey % 300"})
_UNITS = Said("customer", {"unit_id": "c_custkey"}, "c_custkey % 11 <> 0")


@query(f"""WITH r AS {Said("orders", {"repair_id": "o_orderkey", "publication_id": "o_custkey", "target_generation": "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 40 END", "created_at": "o_orderdate"})},
p AS {Said("customer", {"publication_id": "c_custkey", "derivation_id": "c_custkey % 600"})}, s AS {_SELECTIONS}, g AS {_GENERATIONS}
SELECT r.repair_id FROM r JOIN p USING (publication_id) JOIN s USING (derivation_id) JOIN g ON g.generation_id = s.generation_id LEFT JOIN g x ON x.generation_id = r.target_generation
WHERE g.state = 'active' AND (r.target_generation IS NULL OR x.source_manifest_revision <> g.manifest_revision) ORDER BY r.created_at, r.repair_id LIMIT 500""")
def repairs_to_make(t):
    repairs = Said("orders", {"repair_id": "o_orderkey", "publication_id": "o_custkey", "target_generation": "CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 40 END", "created_at": "o_orderdate"})(t)
    publications = Said("customer", {"publication_id": "c_custkey", "derivation_id": "c_custkey % 600"})(t)
    return R.pending_repairs(repairs, publications, _SELECTIONS(t).drop("unit_id"), _GENERATIONS(t), 500).select("repair_id")


_JOBS = Said("orders", {"id": "o_orderkey", "kind": "CASE WHEN o_orderkey % 5 = 0 THEN 'remove' ELSE 'distill' END", "state": "CASE WHEN o_orderkey % 4 = 0 THEN 'running' WHEN o_orderkey % 4 = 1 THEN 'succeeded' WHEN o_orderkey % 4 = 2 THEN 'queued' ELSE 'failed' END", "current_attempt_id": "o_custkey", "enqueued_at": "o_orderdate", "consumed_input_revision": "'i' || o_custkey % 400"})
_ATTEMPTS = Said("customer", {"attempt_id": "c_custkey", "receipt_id": "'q' || c_custkey"}, "c_custkey % 6 <> 0")
_OPERATIONS = Said("customer", {"operation_id": "CASE WHEN c_custkey % 2 = 0 THEN 'publish:q' || c_custkey ELSE 'claim:q' || c_custkey END"})


@query(f"""WITH j AS {_JOBS}, a AS {_ATTEMPTS}, r AS {_RECEIPTS}, o AS {_OPERATIONS}
SELECT r.receipt_id, r.receipt FROM j JOIN a ON a.attempt_id = j.current_attempt_id JOIN r USING (receipt_id) LEFT JOIN o ON o.operation_id = 'publish:' || r.receipt_id
WHERE kind = 'distill' AND state IN ('running', 'succeeded') AND o.operation_id IS NULL ORDER BY enqueued_at, id LIMIT 1000""")
def receipts_to_reconcile(t):
    return R.reconcilable_receipts(_JOBS(t), _ATTEMPTS(t), _RECEIPTS(t).select("receipt_id", "receipt"), _OPERATIONS(t), 1000)


@query(f"""WITH s AS {_SELECTIONS}, d AS {_DERIVATIONS}, r AS {_RECEIPTS}, g AS {_GENERATIONS}, u AS {_UNITS}
SELECT s.unit_id, s.generation_id, r.receipt FROM s JOIN d USING (derivation_id) JOIN r USING (receipt_id) JOIN g USING (generation_id) JOIN u ON u.unit_id = s.unit_id WHERE g.state IN ('active', 'candidate')""")
def receipts_selected(t):
    return R.selected_receipts(_SELECTIONS(t), _DERIVATIONS(t), _RECEIPTS(t).select("receipt_id", "receipt"), _GENERATIONS(t), _UNITS(t))


@query(f"""WITH g AS {_GENERATIONS}, m AS (SELECT n_nationkey AS generation_id, n_regionkey AS manifest_revision, CASE WHEN n_nationkey % 4 = 1 THEN NULL ELSE 'n' || n_nationkey END AS last FROM nation), r AS {_RECEIPTS}
SELECT g.generation_id, r.receipt FROM g JOIN m USING (generation_id, manifest_revision) JOIN r ON r.namespace = m.last WHERE g.state IN ('active', 'candidate')""")
def heads_of_collections(t):
    n = F.col("n_nationkey").cast("string")
    layers = F.when(F.col("n_nationkey") % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("base"), F.concat(F.lit("n"), n)))
    manifests = t("nation").select(F.col("n_nationkey").alias("generation_id"), F.col("n_regionkey").alias("manifest_revision"), layers.alias("aggregate_layers"))
    return R.collection_heads(_GENERATIONS(t), manifests, _RECEIPTS(t).select("namespace", "receipt"))


_ADMISSION = {
    "jobs": Said("orders", {"id": "o_orderkey", "unit_id": "o_custkey", "kind": "CASE WHEN o_orderkey % 17 = 0 THEN 'remove' ELSE 'distill' END", "state": "CASE WHEN o_orderkey % 4 = 0 THEN 'queued' WHEN o_orderkey % 4 = 1 THEN 'failed' WHEN o_orderkey % 4 = 2 THEN 'running' ELSE 'succeeded' END", "quarantine": "o_orderkey % 19 = 0", "target_generation": "o_custkey % 25", "consumed_input_revision": "o_custkey", "recipe_digest": "o_custkey % 5", "current_attempt_id": "o_orderkey", "enqueued_at": "o_orderdate"}),
    "requirements": Said("customer", {"unit_id": "c_custkey", "generation_id": "c_custkey % 25", "invalidated": "c_custkey % 23 = 0", "excluded": "c_custkey % 29 = 0", "enqueue_mode": "CASE WHEN c_custkey % 7 = 0 THEN 'held' ELSE 'active' END", "record_revision": "c_custkey % 2", "inventory_revision": "c_custkey % 3", "consumed_input_revision": "c_custkey", "recipe_digest": "c_custkey % 5"}),
    "generations": _GENERATIONS,
    "units": Said("customer", {"unit_id": "c_custkey", "kind": "CASE WHEN c_custkey % 3 = 0 THEN 'section' ELSE 'paper' END", "record_key": "CASE WHEN c_custkey % 4 <> 0 THEN c_custkey END", "quarantine": "c_custkey % 31 = 0"}),
    "inputs": Said("customer", {"consumed_input_revision": "c_custkey", "mapping_revision": "c_custkey % 2", "parent_evidence_revision": "c_custkey % 2", "tier": "CASE WHEN c_custkey % 3 = 1 THEN 'abstract' END"}),
    "records": Said("customer", {"key": "c_custkey", "policy": "CASE WHEN c_custkey % 13 = 0 THEN 'unknown' WHEN c_custkey % 2 = 0 THEN 'override' ELSE 'clear' END", "merge": "CASE WHEN c_custkey % 37 = 0 THEN 'alias' ELSE 'canonical' END", "quarantine": "c_custkey % 41 = 0", "revision": "c_custkey % 2"}),
    "attempts": Said("orders", {"attempt_id": "o_orderkey", "receipt_id": "'q' || o_orderkey", "lease_expires_at": "CAST(o_orderdate AS TIMESTAMP)", "base_revision": "o_custkey % 3"}),
    "operations": Said("orders", {"operation_id": "'publish:q' || o_orderkey"}, "o_orderkey % 3 = 0"),
    "reducers": Said("customer", {"unit_id": "c_custkey", "consumed_input_revision": "c_custkey", "parked": "c_custkey % 43 = 0"}, "c_custkey % 2 = 0"),
    "mappings": Said("customer", {"unit_id": "c_custkey", "mapping_revision": "c_custkey % 2", "parent_unit_id": "c_custkey + 1", "parent_evidence_revision": "c_custkey % 2"}),
    "heads": Said("customer", {"parent_unit_id": "c_custkey", "generation_id": "(c_custkey - 1) % 25", "inventory_revision": "(c_custkey - 1) % 3", "invalidated": "c_custkey % 47 = 0", "record_revision": "c_custkey % 2"}),
    "windows": Said("region", {"starts_at": "TIMESTAMP '1997-01-01 00:00:00'", "ends_at": "TIMESTAMP '1998-01-01 00:00:00'"}, "r_regionkey = 1"),
}


def _admission_sql() -> str:
    ctes = ",\n".join(f"{k} AS {v}" for k, v in _ADMISSION.items())
    return f"""WITH {ctes},
recipes AS (SELECT n_nationkey AS recipe_digest, n_nationkey % 2 = 0 AS full_vectors, CASE WHEN n_nationkey % 3 <> 0 THEN 'e' || n_nationkey % 3 END AS embedding FROM nation),
inventories AS (SELECT c_custkey AS parent_unit_id, (c_custkey - 1) % 3 AS inventory_revision, CASE WHEN c_custkey % 53 = 0 THEN 'whole' ELSE 'sections' END AS mode, c_custkey - 1 AS child, (c_custkey - 1) % 2 AS child_revision, (c_custkey - 1) % 2 AS parent_evidence_revision FROM customer)
SELECT j.id AS job_id, j.unit_id, j.target_generation AS generation_id
FROM jobs j JOIN requirements q ON q.unit_id = j.unit_id AND q.generation_id = j.target_generation JOIN generations g ON g.generation_id = j.target_generation JOIN units u ON u.unit_id = j.unit_id
JOIN inputs i ON i.consumed_input_revision = j.consumed_input_revision JOIN recipes p ON p.recipe_digest = j.recipe_digest
LEFT JOIN records r ON r.key = u.record_key LEFT JOIN attempts a ON a.attempt_id = j.current_attempt_id LEFT JOIN operations o ON o.operation_id = 'publish:' || a.receipt_id
LEFT JOIN reducers c ON c.unit_id = j.unit_id AND c.consumed_input_revision = j.consumed_input_revision
LEFT JOIN mappings m ON m.unit_id = u.unit_id AND m.mapping_revision = i.mapping_revision LEFT JOIN units v ON v.unit_id = m.parent_unit_id LEFT JOIN records w ON w.key = v.record_key
LEFT JOIN heads h ON h.parent_unit_id = v.unit_id AND h.generation_id = j.target_generation LEFT JOIN inventories n ON n.parent_unit_id = h.parent_unit_id AND n.inventory_revision = h.inventory_revision
WHERE j.kind = 'distill' AND NOT q.invalidated AND NOT q.excluded AND NOT j.quarantine AND NOT u.quarantine AND NOT coalesce(c.parked, false)
AND q.consumed_input_revision = j.consumed_input_revision AND q.recipe_digest = j.recipe_digest
AND (g.state = 'active' OR g.state = 'candidate' AND EXISTS (SELECT 1 FROM windows WHERE starts_at <= TIMESTAMP '1997-06-01' AND ends_at > TIMESTAMP '1997-06-01')) AND (g.state = 'candidate' OR q.enqueue_mode = 'active')
AND (u.record_key IS NULL OR r.policy IN ('clear', 'override') AND r.merge = 'canonical' AND NOT r.quarantine AND q.record_revision = r.revision)
AND (u.kind <> 'section' OR v.unit_id IS NOT NULL AND NOT v.quarantine AND NOT h.invalidated AND h.inventory_revision = q.inventory_revision AND n.mode = 'sections' AND n.child = u.unit_id AND n.child_revision = m.mapping_revision
 AND n.parent_evidence_revision = m.parent_evidence_revision AND i.parent_evidence_revision = m.parent_evidence_revision AND (v.record_key IS NULL OR w.policy IN ('clear', 'override') AND w.merge = 'canonical' AND NOT w.quarantine AND h.record_revision = w.revision))
AND (NOT (p.full_vectors AND coalesce(i.tier, 'fulltext') = 'fulltext') OR p.embedding IS NOT NULL AND (g.retrieval_contract IS NULL OR g.retrieval_contract = p.embedding))
AND (j.state IN ('queued', 'failed') OR j.state = 'running' AND a.lease_expires_at <= TIMESTAMP '1997-06-01' OR j.state = 'succeeded' AND o.operation_id IS NULL AND a.base_revision <> g.manifest_revision)"""


@query(_admission_sql())
def jobs_admitted(t):
    tables = {k: v(t) for k, v in _ADMISSION.items()}
    n, c = F.col("n_nationkey"), F.col("c_custkey")
    outputs = F.create_map(F.lit("fulltext"), F.when(n % 2 == 0, F.array(F.lit("graph"), F.lit("vectors"))).otherwise(F.array(F.lit("graph"))), F.lit("abstract"), F.array(F.lit("graph")))
    tables["recipes"] = t("nation").select(n.alias("recipe_digest"), outputs.alias("outputs"), F.when(n % 3 != 0, F.concat(F.lit("e"), (n % 3).cast("string"))).alias("embedding"))
    tables["inventories"] = t("customer").select(c.alias("parent_unit_id"), ((c - 1) % 3).alias("inventory_revision"), F.when(c % 53 == 0, "whole").otherwise("sections").alias("mode"), F.create_map(c - 1, (c - 1) % 2).alias("mapping_revisions"), F.array(c - 1).alias("units"), ((c - 1) % 2).alias("parent_evidence_revision"))
    return R.admission_jobs(tables, F.lit("1997-06-01").cast("timestamp"))


# Sets


@query(f"""WITH r AS {_RECEIPTS}, d AS {_DERIVATIONS} SELECT 'm' || n_regionkey AS namespace FROM nation UNION SELECT 'base' FROM nation UNION SELECT 'l' || r.namespace FROM r JOIN d USING (receipt_id)
UNION SELECT 'p' || s_nationkey FROM supplier WHERE s_suppkey % 3 <> 0 AND (s_suppkey % 5 = 0 OR s_suppkey % 50 > 20) UNION SELECT 'a' || o_custkey % 90 FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 7 = 0""")
def namespaces_in_use(t):
    def said(prefix, c):
        return F.concat(F.lit(prefix), F.col(c).cast("string"))

    manifests = t("nation").select(F.array(F.lit("base"), said("m", "n_regionkey")).alias("aggregate_layers"))
    receipts = _RECEIPTS(t).select("receipt_id", F.array(F.concat(F.lit("l"), "namespace")).alias("aggregate_layers"))
    s = F.col("s_suppkey")
    pins = t("supplier").select(F.array(said("p", "s_nationkey")).alias("namespaces"), F.when(s % 3 == 0, F.lit(1)).alias("released_at"), F.when(s % 5 != 0, s % 50).alias("expires_at"))
    o = F.col("o_orderkey")
    attempts = t("orders").select(F.concat(F.lit("a"), (F.col("o_custkey") % 90).cast("string")).alias("namespace"), F.when(o % 4 != 0, "done").alias("outcome"), F.when(o % 7 == 0, "unknown").otherwise("known").alias("cost_state"))
    return R.protected_namespaces(manifests, _DERIVATIONS(t), receipts, pins, attempts, F.lit(20))


@query(f"""WITH q AS {Said("customer", {"generation_id": "c_nationkey", "excluded": "c_custkey % 3 = 0", "consumed_input_revision": "'i' || c_custkey % 500"})}, g AS {_GENERATIONS}, j AS {_JOBS}
SELECT consumed_input_revision FROM q JOIN g USING (generation_id) WHERE state IN ('active', 'candidate') AND NOT excluded UNION SELECT consumed_input_revision FROM j WHERE kind = 'distill' AND state IN ('queued', 'running')""")
def inputs_in_use(t):
    q = Said("customer", {"generation_id": "c_nationkey", "excluded": "c_custkey % 3 = 0", "consumed_input_revision": "'i' || c_custkey % 500"})(t)
    return R.live_inputs(q, _GENERATIONS(t), _JOBS(t))


@query("""WITH a AS (SELECT c_custkey AS key FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey % 3 = 0)
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'left' WHEN a.key IS NULL THEN 'right' ELSE 'both' END AS part FROM a FULL JOIN b ON a.key = b.key""")
def key_sets(t):
    return R.set_report(t("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key")), t("orders").where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("key")), "key")


# Writes


_CHANGED = Said("customer", {"key": "c_custkey", "payload": "'new' || c_custkey"}, "c_custkey % 9 = 0")


@query("""WITH RECURSIVE kept AS (SELECT c_custkey AS key, c_custkey - 1 AS target FROM customer WHERE c_custkey % 10 = 3 AND (c_custkey - 1) % 9 <> 0), fresh AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 70 = 7 THEN c_custkey + 10 WHEN c_custkey % 70 = 17 THEN c_custkey - 10 WHEN c_custkey % 70 = 27 THEN -c_custkey ELSE c_custkey + 2 END AS target FROM customer WHERE c_custkey % 10 = 7),
a AS (SELECT * FROM kept WHERE key NOT IN (SELECT key FROM fresh) UNION ALL SELECT * FROM fresh), r AS (SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT key FROM a)),
w AS (SELECT key, target AS node FROM a UNION SELECT w.key, a.target FROM w JOIN a ON a.key = w.node), e AS (SELECT key, max(node) FILTER (node NOT IN (SELECT key FROM a)) AS root FROM w GROUP BY key)
SELECT 'alias' AS what, key, CAST(target AS VARCHAR) AS value FROM a UNION ALL SELECT 'record', key, CASE WHEN key % 9 = 0 THEN 'new' ELSE 'old' END || key FROM r UNION ALL SELECT 'problem', key, CASE WHEN root IS NULL THEN 'cycle' ELSE 'dangling' END FROM e WHERE root IS NULL OR root NOT IN (SELECT key FROM r)""")
def alias_batches(t):
    c = F.col("c_custkey")
    records = t("customer").select(c.alias("key"), F.concat(F.lit("old"), c.cast("string")).alias("payload"))
    aliases = t("customer").where(c % 10 == 3).select(c.alias("key"), (c - 1).alias("target"))
    new = t("customer").where(c % 10 == 7).select(c.alias("key"), F.when(c % 70 == 7, c + 10).when(c % 70 == 17, c - 10).when(c % 70 == 27, -c).otherwise(c + 2).alias("target"))
    rows, after, problems = R.alias_delta(records, aliases, _CHANGED(t), new)
    return after.select(F.lit("alias").alias("what"), "key", F.col("target").cast("string").alias("value")).unionByName(rows.select(F.lit("record").alias("what"), "key", F.col("payload").alias("value"))).unionByName(problems.select(F.lit("problem").alias("what"), "key", F.col("reason").alias("value")))


@query("""WITH r AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN '10.1/a' || c_custkey ELSE '' END AS own FROM customer), f AS (SELECT c_custkey AS key, '10.1/A' || CASE WHEN c_custkey % 3 = 0 THEN c_custkey + 1 WHEN c_custkey % 5 = 0 THEN c_custkey // 10 * 10 + 100001 ELSE c_custkey + 100000 END AS value FROM customer WHERE c_custkey % 7 <> 0)
SELECT f.key, value, CASE WHEN r.own <> '' THEN 'kept' WHEN lower(value) IN (SELECT own FROM r WHERE own <> '') THEN 'owned' WHEN count(*) OVER (PARTITION BY lower(value)) > 1 THEN 'contested' ELSE 'filled' END AS outcome FROM f JOIN r USING (key)""")
def identifiers_found(t):
    c = F.col("c_custkey")
    records = t("customer").select(c.alias("key"), F.when(c % 4 == 0, F.concat(F.lit(" 10.1/a"), c.cast("string"))).alias("doi"))
    n = F.when(c % 3 == 0, c + 1).when(c % 5 == 0, F.floor(c / 10) * 10 + 100001).otherwise(c + 100000)
    return R.filled_identifiers(records, t("customer").where(c % 7 != 0).select(c.alias("key"), F.concat(F.lit("10.1/A"), n.cast("string")).alias("value")))


@query("""SELECT 's' AS source, coalesce(a.k, b.k) AS source_id, CASE WHEN b.k IS NULL THEN 'd' || a.k ELSE 'e' || b.k END AS doc_id, CASE WHEN b.k IS NULL THEN 'done' ELSE 'error' END AS status, CASE WHEN b.k % 4 = 0 THEN 'new' WHEN a.k IS NOT NULL THEN 'old' END AS fingerprint
FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0) b ON a.k = b.k""")
def ledger_writes(t):
    c = F.col("c_custkey")
    ledger = t("customer").where(c % 3 != 0).select(F.lit("s").alias("source"), c.alias("source_id"), F.concat(F.lit("d"), c.cast("string")).alias("doc_id"), F.lit("done").alias("status"), F.lit("old").alias("fingerprint"))
    writes = t("customer").where(c % 2 == 0).select(F.lit("s").alias("source"), c.alias("source_id"), F.concat(F.lit("e"), c.cast("string")).alias("doc_id"), F.lit("error").alias("status"), F.when(c % 4 == 0, "new").alias("fingerprint"))
    return R.ledger_upsert(ledger, writes)


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 6 = 0 THEN 'deleted' ELSE 'changed' END AS breach FROM customer WHERE c_custkey % 6 = 0 OR c_custkey % 10 = 1")
def log_breaches(t):
    c = F.col("c_custkey")
    before = t("customer").select(c.alias("key"), F.col("c_name").alias("a"), F.when(c % 3 == 0, 1).alias("b"))
    after = t("customer").where(c % 6 != 0).select(c.alias("key"), F.when(c % 10 == 1, "x").otherwise(F.col("c_name")).alias("a"), F.when(c % 3 == 0, 1).alias("b"))
    return R.append_only_breaches(before, after.unionByName(after.select((F.col("key") + 1_000_000).alias("key"), "a", "b")), "key")


@query("""WITH e AS (SELECT event_id + 1 AS seq, user_id AS row_id, CASE WHEN event_type = 'error' THEN 'DELETE' WHEN event_type = 'signup' THEN 'INSERT' ELSE 'UPDATE' END AS op, CASE WHEN event_type = 'error' THEN NULL ELSE 'v' || event_id % 3 END AS new FROM events),
f AS (SELECT *, event_before FROM (SELECT e.*, coalesce(CASE WHEN lag(seq) OVER w IS NULL THEN CASE WHEN row_id % 2 = 0 THEN 'v0' END ELSE lag(new) OVER w END, NULL) AS event_before FROM e WINDOW w AS (PARTITION BY row_id ORDER BY seq))),
p AS (SELECT *, CASE WHEN op = 'INSERT' AND event_before IS NOT NULL THEN 'present' WHEN op <> 'INSERT' AND event_before IS NULL THEN 'absent' WHEN op <> 'INSERT' AND event_before <> 'v1' THEN 'conflict' END AS problem FROM f),
r AS (SELECT row_id, max(seq) AS sequence, arg_max(coalesce(new, '-'), seq) AS state, arg_min(problem, seq) FILTER (problem IS NOT NULL) AS problem FROM p GROUP BY row_id)
SELECT row_id, sequence, CASE WHEN state <> '-' THEN state END AS state, problem FROM r UNION ALL SELECT c_custkey, 0, 'v0', NULL FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT row_id FROM r)""")
def journal_replays(t):
    e = F.col("event_id")
    op = F.when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "signup", "INSERT").otherwise("UPDATE")
    journal = t("events").select((e + 1).alias("sequence"), F.col("user_id").alias("row_id"), op.alias("operation"), F.lit("v1").alias("old_image"), F.concat(F.lit("v"), (e % 3).cast("string")).alias("new_image"))
    rows = t("events").select(F.col("user_id").alias("row_id")).union(t("customer").select("c_custkey")).distinct().where("row_id % 2 = 0").select("row_id", F.lit("v0").alias("image"))
    return R.replayed(rows, journal)


# Of an even user the ledger's snapshot has a row; a user's events change it in turn: insert, update, delete.
_HISTORY = """SELECT event_id, user_id AS u, CAST(event_id + 1 AS BIGINT) AS sequence, (row_number() OVER w + CASE WHEN user_id % 2 = 0 THEN 0 ELSE 2 END) % 3 AS turn, concat('d', (user_id + event_id % 2) % 50) AS doc, event_id % 7 - 1 AS failures,
lag(concat('d', (user_id + event_id % 2) % 50), 1, concat('d', user_id % 50)) OVER w AS was, lag(event_id % 7 - 1, 1, user_id % 5) OVER w AS had FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""
_IMPORT = f"""WITH c AS MATERIALIZED ({_HISTORY}), m AS (SELECT c_custkey AS row_id, 'x' || c_custkey % 40 AS unit FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'y' || c_custkey % 4 FROM customer WHERE c_custkey % 11 = 0), st AS (SELECT 'd' || n_nationkey * 2 AS doc FROM nation UNION ALL SELECT 'd' || n_nationkey FROM nation WHERE n_nationkey % 5 = 0 UNION ALL SELECT 'z' || n_regionkey FROM nation WHERE n_regionkey < 2),
s AS MATERIALIZED (SELECT DISTINCT 0 AS sequence, 'SNAPSHOT' AS operation, user_id AS row_id, 'd' || user_id % 50 AS doc, user_id % 5 AS failures, 1 AS delta FROM events WHERE user_id % 2 = 0 UNION ALL SELECT sequence, CASE WHEN turn = 1 THEN 'UPDATE' ELSE 'INSERT' END, u, doc, failures, 1 FROM c WHERE turn <> 2 UNION ALL SELECT sequence, CASE WHEN turn = 2 THEN 'DELETE' END, u, was, had, -1 FROM c WHERE turn <> 0),
pop AS (SELECT *, sum(delta) OVER (PARTITION BY doc ORDER BY sequence RANGE UNBOUNDED PRECEDING) AS docs FROM s), k AS (SELECT row_id, count(*) AS n, min(unit) AS unit FROM m GROUP BY 1),
un AS (SELECT DISTINCT unit, sequence, sum(delta) OVER (PARTITION BY unit ORDER BY sequence RANGE UNBOUNDED PRECEDING) AS rows_ FROM s JOIN (SELECT DISTINCT * FROM m) USING (row_id)),
e AS MATERIALIZED (SELECT p.row_id, p.sequence, operation, delta < 0 AS deleted, p.doc, CASE WHEN n = 1 THEN k.unit END AS unit_id, failures, [CASE WHEN q.t IS NULL THEN 'ledger_only' ELSE 'matched' END] || CASE WHEN n > 1 THEN ['conflicting_mapping'] WHEN n IS NULL THEN ['unmatched_unit'] ELSE [] END || CASE WHEN n = 1 AND rows_ > 1 THEN ['duplicate_unit'] ELSE [] END || CASE WHEN docs > 1 THEN ['duplicate_document_identity'] ELSE [] END
 || CASE WHEN q.t > 1 THEN ['duplicate_docstatus'] ELSE [] END || ['provenance_gap'] || CASE WHEN delta < 0 THEN ['source_deleted'] ELSE [] END || CASE WHEN failures < 0 THEN ['invalid_failure_counter'] ELSE [] END AS dispositions
 FROM pop p LEFT JOIN k USING (row_id) LEFT JOIN un ON un.unit = k.unit AND un.sequence = p.sequence LEFT JOIN (SELECT doc, count(*) AS t FROM st GROUP BY 1) q ON q.doc = p.doc WHERE operation IS NOT NULL)"""


def _import(t):
    u, own = F.col("user_id"), ("row_id", "doc", "failures")
    c = t("events").sparkSession.sql(_HISTORY.replace("FROM events", "FROM {events}"), events=t("events"))
    old = F.struct(F.col("u").alias("row_id"), F.col("was").alias("doc"), F.col("had").alias("failures"))
    new = F.struct(F.col("u").alias("row_id"), "doc", "failures")
    changes = c.select("sequence", F.when(F.col("turn") == 1, "UPDATE").when(F.col("turn") == 2, "DELETE").otherwise("INSERT").alias("operation"), F.when(F.col("turn") != 0, old).alias("old"), F.when(F.col("turn") != 2, new).alias("new"))
    snapshot = t("events").where(u % 2 == 0).select(u.alias("row_id"), F.concat(F.lit("d"), u % 50).alias("doc"), (u % 5).alias("failures")).distinct()
    k, n, r = F.col("c_custkey"), F.col("n_nationkey"), F.col("n_regionkey")
    mappings = t("customer").where(k % 3 != 0).select(k.alias("row_id"), F.concat(F.lit("x"), k % 40).alias("unit_id")).union(t("customer").where(k % 11 == 0).select(k, F.concat(F.lit("y"), k % 4)))
    statuses = t("nation").select(F.concat(F.lit("d"), n * 2).alias("doc")).union(t("nation").where(n % 5 == 0).select(F.concat(F.lit("d"), n))).union(t("nation").where(r < 2).select(F.concat(F.lit("z"), r)))
    image = [F.to_json(F.struct(*[F.col(f"{side}{f}") for f in own])).alias(name) for side, name in (("", "image"), ("old.", "old_image"), ("new.", "new_image"))]
    I.checked_changes(snapshot.select("row_id", image[0]), changes.select("sequence", "operation", F.col("old.row_id").alias("old_id"), F.when(F.col("old").isNotNull(), image[1]).alias("old_image"), F.col("new.row_id").alias("new_id"), F.when(F.col("new").isNotNull(), image[2]).alias("new_image")), 0)
    return I.import_events(snapshot, changes, mappings, statuses), statuses


@query(_IMPORT + " SELECT * FROM e")
def import_dispositions(t):
    return _import(t)[0]


@query(_IMPORT + """, l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY sequence DESC) = 1), a AS (SELECT doc FROM st WHERE doc NOT IN (SELECT doc FROM l WHERE NOT deleted))
SELECT unnest([CASE WHEN list_contains(dispositions, 'matched') THEN 'matches' ELSE 'ledger_only' END, 'provenance_gaps'] || CASE WHEN len(list_filter(dispositions, lambda x: starts_with(x, 'duplicate'))) > 0 THEN ['duplicates'] ELSE [] END || CASE WHEN list_has_any(dispositions, ['conflicting_mapping', 'invalid_failure_counter']) THEN ['conflicts'] ELSE [] END) AS name, row_id, doc, sequence FROM l
UNION ALL SELECT 'docstatus_only', NULL, doc, NULL FROM a UNION ALL SELECT 'duplicates', NULL, doc, NULL FROM a GROUP BY doc HAVING count(*) > 1""")
def sets_of_import(t):
    return I.import_sets(*_import(t))


@query("""WITH h AS (SELECT o_custkey AS p, min(o_orderkey) AS rev FROM orders GROUP BY 1), own AS (SELECT * FROM h WHERE p % 4 = 1), u AS (SELECT p AS unit FROM own UNION SELECT l_suppkey + 100000 FROM lineitem JOIN own ON l_orderkey = rev),
q AS (SELECT c_custkey AS unit, c_custkey % 50 AS i, c_custkey % 9 AS r FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT s_suppkey + 100000, s_suppkey % 70, s_suppkey % 12 FROM supplier),
n AS (SELECT i FROM q JOIN u USING (unit) UNION SELECT 200 + p % 3 FROM own WHERE p % 8 = 1), m AS (SELECT DISTINCT r FROM q JOIN u USING (unit))
SELECT 'unit' AS kind, unit AS id FROM u UNION ALL SELECT CASE WHEN i % 60 <> 7 THEN 'input' ELSE 'missing input' END, i FROM n UNION ALL SELECT CASE WHEN r <> 5 THEN 'recipe' ELSE 'missing recipe' END, r FROM m""")
def replay_closures(t):
    spark = t("orders").sparkSession
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    heads = t("orders").groupBy(F.col("o_custkey").alias("parent_unit_id")).agg(F.min("o_orderkey").alias("inventory_revision")).withColumn("generation_id", F.lit("g1"))
    heads = heads.unionByName(heads.withColumn("generation_id", F.lit("g0")))
    sections = t("lineitem").groupBy(F.col("l_orderkey").alias("inventory_revision")).agg(F.collect_set(F.col("l_suppkey") + 100000).alias("units"))
    p = F.col("o_custkey")
    inventories = t("orders").select(p.alias("parent_unit_id"), F.col("o_orderkey").alias("inventory_revision"), F.when(p % 8 == 1, 200 + p % 3).alias("parent_input")).join(sections, "inventory_revision")
    req = t("customer").where(c % 2 == 1).select(c.alias("unit_id"), F.lit("g1").alias("generation_id"), (c % 50).alias("consumed_input_revision"), (c % 9).alias("recipe_digest"))
    req = req.unionByName(t("supplier").select((s + 100000).alias("unit_id"), F.lit("g1").alias("generation_id"), (s % 70).alias("consumed_input_revision"), (s % 12).alias("recipe_digest")))
    inputs = spark.range(300).where("id % 60 <> 7").select(F.col("id").alias("consumed_input_revision"))
    return R.replay_closure(heads, inventories, req, inputs, spark.range(20).where("id <> 5").select(F.col("id").alias("recipe_digest")), "g1", t("customer").where(c % 4 == 1).select(c.alias("parent_unit_id")))


# Reports


@query(f"""WITH r AS {_RECORDS} SELECT 'status:' || CASE WHEN coalesce(download_status, '') = '' THEN 'other' ELSE download_status END AS measure, count(*) AS n FROM r GROUP BY 1
UNION ALL SELECT 'ok_total', count(*) FILTER (download_status = 'ok') FROM r UNION ALL SELECT 'ok_has_md', count(*) FILTER (download_status = 'ok' AND has_md) FROM r UNION ALL SELECT 'ok_has_txt', count(*) FILTER (download_status = 'ok' AND has_txt) FROM r
UNION ALL SELECT 'ok_missing_both', count(*) FILTER (download_status = 'ok' AND NOT has_md AND NOT has_txt) FROM r""")
def queue_reports(t):
    return R.queue_report(_RECORDS(t))


@query(f"SELECT key, doi, arxiv_id, added_at FROM {_RECORDS} WHERE download_status = 'failed' ORDER BY coalesce(added_at, '') DESC, key LIMIT 10")
def latest_failures(t):
    return R.recent_failed(_RECORDS(t))


_FILES = Said("orders", {"key": "o_custkey + 20 * CAST(floor(o_orderkey % 7 / 6) AS INT)", "kind": "CASE WHEN o_orderkey % 3 = 0 THEN 'pdf' WHEN o_orderkey % 3 = 1 THEN 'md' ELSE 'txt' END", "path": "'x/' || o_custkey"}, "o_orderstatus = 'P'")


@query(f"""WITH f AS (SELECT DISTINCT key, kind FROM {_FILES}), r AS (SELECT c_custkey AS key, k.kind, CASE WHEN c_custkey % 5 = 0 THEN 'p' WHEN c_custkey % 5 = 1 THEN '' END AS path FROM customer, (SELECT unnest(['pdf', 'md', 'txt']) AS kind) k)
SELECT CASE WHEN f.key IS NOT NULL THEN 'drift' ELSE 'dangling' END AS problem, r.key, r.kind FROM r LEFT JOIN f ON f.key = r.key AND f.kind = r.kind WHERE (f.key IS NOT NULL) <> (coalesce(path, '') <> '')
UNION ALL SELECT 'orphan', key, kind FROM f WHERE key NOT IN (SELECT key FROM r)""")
def audits(t):
    c = F.col("c_custkey")
    records = t("customer").select(c.alias("key"), F.when(c % 5 == 0, "p").when(c % 5 == 1, "").alias("path")).withColumn("kind", F.explode(F.array(F.lit("pdf"), F.lit("md"), F.lit("txt"))))
    return R.audit(records, _FILES(t).select("key", "kind"))


@query(f"""WITH f AS (SELECT DISTINCT key, kind, path FROM {_FILES}) SELECT c_custkey AS key, f.kind, f.path FROM customer JOIN f ON f.key = c_custkey AND f.kind = 'md' WHERE c_custkey % 4 <> 0""")
def paths_backfilled(t):
    c = F.col("c_custkey")
    records = t("customer").select(c.alias("key"), F.lit("md").alias("kind"), F.when(c % 4 == 0, "there").when(c % 4 == 1, " ").alias("path"))
    return R.backfilled_paths(records, _FILES(t).distinct())


@query(f"""WITH r AS (SELECT *, CASE WHEN has_md THEN 'TERMINAL' WHEN has_txt THEN 'EXTRACT' ELSE 'DOWNLOAD' END AS route, key % 3 = 0 AS d FROM {_RECORDS}), m AS (SELECT *, NOT d OR row_number() OVER (PARTITION BY route, d ORDER BY key) <= 2 AS ok FROM r)
SELECT route, count(*) AS n, least(count(*) FILTER (ok), 200) AS taken, count(*) - count(*) FILTER (ok) AS held FROM m GROUP BY route""")
def sweep_routes(t):
    route = F.when(F.col("has_md"), "TERMINAL").when(F.col("has_txt"), "EXTRACT").otherwise("DOWNLOAD")
    return R.route_counts(_RECORDS(t), route, 200, 2, F.col("key") % 3 == 0)


@query(f"""WITH r AS (SELECT *, CASE WHEN has_md THEN 'TERMINAL' WHEN has_txt THEN 'EXTRACT' ELSE 'DOWNLOAD' END AS route, key % 3 = 0 AS d FROM {_RECORDS}), m AS (SELECT *, NOT d OR row_number() OVER (PARTITION BY route, d ORDER BY key) <= 2 AS ok FROM r)
SELECT route, CAST(row_number() OVER (PARTITION BY route ORDER BY key) - 1 AS INTEGER) AS place, key FROM m WHERE ok QUALIFY place < 200""")
def sweep_rows(t):
    route = F.when(F.col("has_md"), "TERMINAL").when(F.col("has_txt"), "EXTRACT").otherwise("DOWNLOAD")
    return R.routes_taken(_RECORDS(t), route, 200, 2, F.col("key") % 3 == 0)


@query("SELECT c_custkey, c_custkey % 4 <> 0 AND c_custkey % 3 = 0 AND c_custkey % 5 = 2 AS deferred FROM customer")
def deferrals(t):
    c = F.col("c_custkey")
    return t("customer").select("c_custkey", R.deferred_extract(F.when(c % 4 != 0, "a"), F.when(c % 3 == 0, "a").when(c % 3 == 1, "b"), F.when(c % 5 != 0, c % 5), F.lit(2)).alias("deferred"))


@query(f"""SELECT CASE WHEN arxiv_id <> '' THEN 'arxiv' WHEN title <> '' THEN 'title' ELSE 'none' END AS route, count(*) AS n FROM (SELECT * FROM {_RECORDS} WHERE trim(coalesce(doi, '')) = '' ORDER BY key LIMIT 400) GROUP BY 1""")
def backfill_routes(t):
    return R.identity_backfill(_RECORDS(t), 400)


_MEMBERS = Said("lineitem", {"record": "l_orderkey", "unit": "l_linenumber", "kind": "CASE WHEN l_suppkey % 3 = 0 THEN 'paper' ELSE 'section' END", "tier": "CASE WHEN l_partkey % 3 = 0 THEN 'fulltext' WHEN l_partkey % 3 = 1 THEN 'abstract' ELSE 'metadata' END", "covered": "l_partkey % 5 <> 0", "registered": "l_partkey % 4 = 0", "readable": "l_partkey % 2 = 0", "published": "l_partkey % 7 < 4", "indexed": "l_partkey % 7 < 2"})


@query(f"""WITH m AS {_MEMBERS}, p AS (SELECT record, bool_or(registered) AS registered, count(*) FILTER (kind <> 'section') = 1 AND coalesce(bool_or(readable) FILTER (kind <> 'section'), false) AS readable, count(*) FILTER (kind <> 'section') = 1 AND coalesce(bool_or(published) FILTER (kind <> 'section'), false) AS published,
count(*) FILTER (kind <> 'section') = 1 AND coalesce(bool_or(indexed) FILTER (kind <> 'section'), false) AS indexed, count(*) FILTER (covered AND tier = 'fulltext') AS a, count(*) FILTER (covered AND tier = 'abstract') AS b, count(*) FILTER (covered AND tier = 'metadata') AS c FROM m GROUP BY record)
SELECT count(*) FILTER (registered) AS registered, count(*) FILTER (readable) AS readable, count(*) FILTER (published) AS published, count(*) FILTER (indexed) AS indexed, CAST(sum(a) AS BIGINT) AS tier_fulltext, CAST(sum(b) AS BIGINT) AS tier_abstract, CAST(sum(c) AS BIGINT) AS tier_metadata FROM p""")
def totals_of_coverage(t):
    return R.coverage_totals(_MEMBERS(t))


_EVIDENCE = Said("customer", {"unit": "c_custkey", "record_ok": "CASE WHEN c_custkey % 6 <> 5 THEN c_custkey % 6 > 0 END", "extract_ok": "c_custkey % 5 > 0", "receipt_ok": "c_custkey % 4 > 0", "stale": "CASE WHEN c_custkey % 7 < 6 THEN c_custkey % 7 = 0 END", "quarantine": "CASE WHEN c_custkey % 9 = 0 THEN true END", "roles_ok": "c_custkey % 2 = 0"})


@query(f"""WITH e AS (SELECT unit, coalesce(record_ok, false) AS a, coalesce(quarantine, false) AS q, extract_ok AS b, receipt_ok AS c, coalesce(stale, true) AS s, roles_ok AS d FROM {_EVIDENCE})
SELECT unit, a AND NOT q AS registered, a AND NOT q AND b AS readable, a AND NOT q AND b AND c AND NOT s AS published, a AND NOT q AND b AND c AND NOT s AND d AS indexed,
(CASE WHEN NOT a THEN ['unregistered'] ELSE [] END) || (CASE WHEN q THEN ['quarantined'] ELSE [] END) || (CASE WHEN NOT b THEN ['unreadable'] ELSE [] END) || (CASE WHEN NOT c THEN ['no_receipt'] ELSE [] END) || (CASE WHEN c AND s THEN ['stale_receipt'] ELSE [] END) || (CASE WHEN NOT d THEN ['missing_outputs'] ELSE [] END) AS reasons FROM e""")
def coverage_of_units(t):
    return R.unit_coverage(_EVIDENCE(t))


_DESIRED = Said("customer", {"unit_id": "c_custkey", "selected_derivation_id": "CASE WHEN c_custkey % 8 > 0 THEN c_custkey % 8 END", "excluded": "c_custkey % 10 = 0"})
_COVERED = Said("customer", {"unit_id": "c_custkey", "derivation_id": "CASE WHEN c_custkey % 8 > 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE c_custkey % 8 END END", "source_eligible": "c_custkey % 7 <> 0", "tier_covered": "c_custkey % 11 <> 0", "achieved_tier": "CASE WHEN c_custkey % 2 = 0 THEN 'fulltext' ELSE 'abstract' END", "readable": "c_custkey % 4 = 0", "quarantine": "CASE WHEN c_custkey % 13 = 0 THEN true END", "excluded": "false"}, "c_custkey % 17 <> 0")


@query(f"""WITH d AS {_DESIRED}, c AS {_COVERED}, e AS (SELECT d.unit_id, d.selected_derivation_id AS derivation_id, NOT d.excluded AND c.derivation_id IS NOT DISTINCT FROM d.selected_derivation_id AND coalesce(c.source_eligible, false) AND coalesce(c.tier_covered, false) AND NOT coalesce(c.quarantine, false) AND (achieved_tier IS DISTINCT FROM 'fulltext' OR c.readable) AS eligible FROM d LEFT JOIN c USING (unit_id))
SELECT *, CASE WHEN eligible THEN 'verified_current' ELSE 'ineligible_or_unavailable' END AS reason FROM e""")
def entries_served(t):
    return R.serving_entries(_DESIRED(t), _COVERED(t))


@query("SELECT c_nationkey AS unit, 'r' || c_nationkey % 3 AS recipe, c_nationkey % 2 AS revision FROM customer GROUP BY 1")
def receipts_agreed(t):
    n = F.col("c_nationkey")
    return R.consistent_receipt(t("customer").select(n.alias("unit"), F.concat(F.lit("r"), (n % 3).cast("string")).alias("recipe"), (n % 2).alias("revision")), "unit", ["recipe", "revision"])


@query("""SELECT c_custkey AS key, CASE WHEN c_custkey % 6 = 0 THEN ['not an object'] ELSE (CASE WHEN c_custkey % 4 = 1 THEN ['missing id'] ELSE [] END) || (CASE WHEN c_custkey % 3 = 1 THEN ['missing spans'] ELSE [] END) || (CASE WHEN c_custkey % 4 = 2 THEN ['wrong id'] ELSE [] END) || (CASE WHEN c_custkey % 5 = 1 THEN ['unknown other'] ELSE [] END) END AS problems
FROM customer WHERE c_custkey % 6 = 0 OR c_custkey % 4 IN (1, 2) OR c_custkey % 3 = 1 OR c_custkey % 5 = 1""")
def shapes(t):
    c = F.col("c_custkey")
    ident = F.when(c % 4 == 1, F.lit("")).when(c % 4 == 2, F.lit('"id": [1], ')).otherwise(F.lit('"id": -4, '))
    spans = F.when(c % 3 == 1, F.lit("")).otherwise(F.lit('"spans": [[1, 2]], '))
    other = F.when(c % 5 == 1, F.lit('"other": 1, ')).otherwise(F.lit(""))
    doc = F.when(c % 6 == 0, F.lit("[1]")).otherwise(F.concat(F.lit("{"), ident, spans, other, F.lit('"name": "x", "ok": true}')))
    return R.shape_problems(t("customer").select(c.alias("key"), doc.alias("document")), "key", {"id": "number", "spans": "array", "name": "string", "ok": "boolean"})


# Names


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'textbook' WHEN c_custkey % 4 = 1 THEN 'notebook' END AS source, CASE WHEN c_custkey % 4 = 0 THEN 'jones' || 1900 + c_custkey WHEN c_custkey % 4 = 1 THEN 'n' || c_custkey END AS source_id, 'doc/x' || c_custkey AS base FROM customer""")
def provenance_keys(t):
    c = F.col("c_custkey")
    n = c.cast("string")
    kind = F.when(c % 2 == 0, "textbook").otherwise("notebook")
    key = F.when(c % 4 == 0, F.concat(F.lit("textbook:jones"), (1900 + c).cast("string"))).when(c % 4 == 1, F.concat(F.lit("notebook:n"), n)).when(c % 4 == 2, F.concat(F.lit("textbook:"), n)).otherwise(F.concat(F.lit("textbook:n"), n))
    found = R.provenance_key(kind, key, {"textbook": "^[a-z]+[0-9]{4,}$", "notebook": "^n[0-9]+$"})
    return t("customer").select("c_custkey", found["source"].alias("source"), found["source_id"].alias("source_id"), R.without_section(F.concat(F.lit("doc/x"), n, F.when(c % 3 == 0, "#s12").otherwise(""))).alias("base"))


@query("""SELECT c_custkey, ['10.1/' || c_custkey] || CASE WHEN c_custkey % 2 = 0 THEN ['10.2/x'] ELSE [] END AS dois, ['2001.' || c_custkey] AS arxiv_ids, CASE WHEN c_custkey % 3 = 0 THEN ['https://a.org/' || c_custkey] ELSE [] END AS urls FROM customer""")
def identity_lists(t):
    c = F.col("c_custkey")
    n = c.cast("string")
    dois = F.array(F.concat(F.lit(" DOI:10.1/"), n), F.concat(F.lit("https://dx.doi.org/10.1/"), n), F.lit("  "), F.when(c % 2 == 0, "10.2/x"))
    arxiv = F.array(F.concat(F.lit("arXiv:2001."), n), F.concat(F.lit("oai:arXiv.org:2001."), n), F.concat(F.lit("https://arxiv.org/abs/2001."), n))
    urls = F.array(F.when(c % 3 == 0, F.concat(F.lit("https://a.org/"), n)), F.lit("ftp://a.org"), F.lit("http://u:p@a.org/"), F.lit("https:///x"), F.lit("http://a b.org"))
    return t("customer").select("c_custkey", R.bare_dois(dois).alias("dois"), R.bare_arxiv(arxiv).alias("arxiv_ids"), R.clean_urls(urls).alias("urls"))


@query("""WITH f AS (SELECT l_orderkey AS paper, 's' || l_suppkey % 3 AS source, l_linenumber % 2 AS found, min(l_linenumber) AS seen FROM lineitem GROUP BY 1, 2, 3) SELECT paper, list(source || '/' || found ORDER BY seen, source, found) AS identities FROM f GROUP BY paper""")
def identities_merged(t):
    rows = t("lineitem").select(F.col("l_orderkey").alias("paper"), F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("source"), (F.col("l_linenumber") % 2).alias("found"), "l_linenumber")
    merged = R.merged_identities(rows, "paper", ["source", "found"], "l_linenumber")
    return merged.select("paper", F.transform("identities", lambda x: F.concat_ws("/", x["source"], x["found"].cast("string"))).alias("identities"))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id AS request_id, CASE WHEN event_id % 90 = 0 THEN '' ELSE event_type || CASE WHEN event_id % 3 = 0 THEN '  x ' ELSE ' x ' END || user_id % 20 END AS q, epoch(ts) AS s, epoch(ts) + event_id % 5000 + 900 AS ends FROM events),
f AS MATERIALIZED (SELECT q, s, min(request_id) AS request_id, min_by(ends, request_id) AS ends FROM e WHERE q <> '' GROUP BY q, s), n AS MATERIALIZED (SELECT a.q, a.s, b.s AS then_ FROM f a ASOF JOIN f b ON a.q = b.q AND a.ends <= b.s),
l AS (SELECT q, min(s) AS s FROM f GROUP BY q UNION ALL SELECT n.q, n.then_ FROM l JOIN n ON n.q = l.q AND n.s = l.s),
k AS MATERIALIZED (SELECT q, s, request_id AS leader FROM f SEMI JOIN l USING (q, s))
SELECT e.request_id, k.leader FROM e ASOF LEFT JOIN k ON k.q = e.q AND k.s <= e.s""")
def requests_shared(t):
    i = F.col("event_id")
    text = F.concat(F.lit(" "), F.col("event_type"), F.when(i % 3 == 0, "  x ").otherwise(" x "), (F.col("user_id") % 20).cast("string"), F.when(i % 2 == 0, "\t ").otherwise(""))
    rows = t("events").select(i.alias("request_id"), F.when(i % 90 == 0, "  ").otherwise(text).alias("query"), F.col("ts").cast("timestamp").alias("at"), (i % 5000).cast("double").alias("seconds"))
    return R.requests_joined(rows)


@query("""WITH o AS (SELECT row_number() OVER (ORDER BY priority, queued, id) - 1 AS n, id FROM (SELECT o_custkey, min((o_orderpriority, o_orderdate, o_orderkey)) AS m, m[1] AS priority, m[2] AS queued, m[3] AS id FROM orders GROUP BY 1)) SELECT id AS task_id, CAST(n % 4 AS INTEGER) AS lane, CAST(n // 4 AS INTEGER) AS place FROM o""")
def work_orders(t):
    tasks = t("orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("queued_at"), F.col("o_orderkey").alias("task_id"))
    return R.work_order(tasks, 4)


# Schedules and corrections


@query("""WITH l AS (SELECT event_id, timezone('Asia/Shanghai', timezone('UTC', ts)) AS l FROM events)
SELECT event_id, CASE WHEN isodow(l) <= 5 AND CAST(l AS DATE) <> DATE '2024-01-10' THEN CASE WHEN hour(l) BETWEEN 9 AND 11 THEN CAST(date_trunc('day', l) + INTERVAL 4 HOUR AS VARCHAR) WHEN hour(l) BETWEEN 14 AND 17 THEN CAST(date_trunc('day', l) + INTERVAL 10 HOUR AS VARCHAR) END END AS resumes FROM l""")
def pauses(t):
    until = L.pause_until(F.col("ts").cast("timestamp"), "Asia/Shanghai", [("09:00", "12:00"), ("14:00", "18:00")], range(5), ["2024-01-10"])
    return t("events").select("event_id", F.date_format(until, "yyyy-MM-dd HH:mm:ss").alias("resumes"))


def _conflicts(t):
    o = F.col("o_orderkey")
    return t("orders").select(o.alias("conflict_id"), F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("at"), F.when(o % 3 == 0, "pending").otherwise("resolved").alias("status"))


@query("""WITH p AS (SELECT o_orderkey AS id, o_custkey AS key, o_orderdate AS seen FROM orders WHERE o_orderkey % 3 = 0), k AS (SELECT key, min((seen, id)) AS f FROM p GROUP BY key ORDER BY f LIMIT 20), own AS (SELECT p.*, f, id = f[2] AS lead FROM p JOIN k USING (key))
SELECT id AS conflict_id, CAST(row_number() OVER (ORDER BY NOT lead, CASE WHEN lead THEN seen END, CASE WHEN lead THEN id END, seen, id) - 1 AS INTEGER) AS place FROM own ORDER BY 2 LIMIT 50""")
def correction_batches(t):
    return L.correction_batch(_conflicts(t), 20, 50)


@query("""SELECT count(*) AS n, count(DISTINCT key) AS papers, min(seen) AS first FROM (SELECT o_custkey AS key, o_orderstatus, o_orderpriority, min(o_orderdate) AS seen FROM orders GROUP BY 1, 2, 3)""")
def conflicts_staged(t):
    rows = t("orders").select(F.col("o_custkey").alias("key"), F.struct("o_orderstatus").alias("fields"), F.col("o_orderpriority").alias("existing"), F.lit("x").alias("incoming"), F.lit("merge").alias("operation"), F.col("o_orderdate").alias("at"))
    return L.staged_conflicts(rows).agg(F.count_distinct("conflict_id").alias("n"), F.count_distinct("key").alias("papers"), F.min("at").alias("first"))


@query("""SELECT o_orderkey AS conflict_id, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 4 = 0 AND o_orderkey % 3 <> 0 THEN 'resolved' ELSE 'needs_human' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'unadjudicated' ELSE 'keep' END AS decision FROM orders""")
def adjudications(t):
    o = F.col("o_orderkey")
    answers = t("orders").where(o % 5 != 0).select(o.alias("conflict_id"), F.when(o % 4 == 0, "resolved").otherwise("needs_human").alias("status"), F.lit("keep").alias("decision"), F.when(o % 3 == 0, " ").otherwise("seen").alias("evidence"))
    return L.adjudicated(_conflicts(t), answers)
