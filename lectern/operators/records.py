"""The catalog's own relations: scans, admission, receipts, coverage, reports, replay and repairs.

Tables stand for the catalog's tables; their columns are named in each docstring. Times are columns,
so that every answer is that of one stated moment.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.matching import alias_chase
from lectern.operators.ranking import ranked, ranked_all

# Scans


def batch_scan(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of a table whose key is wanted; a join, however many keys there are."""
    return table.join(wanted.select(key).distinct(), key, "left_semi")


def status_scan(records: DataFrame, status: str) -> DataFrame:
    """Keys of the records with a status, in order."""
    return records.where(F.col("download_status") == status).select("key").orderBy("key")


def ordered_scan(records: DataFrame, key: str = "key") -> DataFrame:
    return records.orderBy(key)


def snapshot(spark: SparkSession, files: Mapping[str, Sequence[str]]) -> dict[str, DataFrame]:
    """Several tables as of one moment: each is read from the very files listed for it, whatever is added later."""
    return {name: spark.read.parquet(*paths) for name, paths in files.items()}


def listed(spark: SparkSession, tables: Mapping[str, str]) -> dict[str, list[str]]:
    """The files that tables hold now, for snapshot()."""
    return {name: sorted(spark.read.parquet(path).inputFiles()) for name, path in tables.items()}


def restored(batches: DataFrame, rows: str, schema: str) -> DataFrame:
    """Rows of a JSON array column, in a table's schema; fields it does not name go, missing ones are null."""
    return batches.select(F.explode(F.from_json(F.col(rows), f"array<struct<{schema}>>")).alias("_r")).select("_r.*")


def citation_counts(records: DataFrame) -> DataFrame:
    """(key, citations) of every record that has a count."""
    return records.where("citation_count IS NOT NULL").select("key", F.col("citation_count").alias("citations"))


def size_totals(objects: DataFrame, key: str = "id", size: str = "size") -> DataFrame:
    """One row: the largest id and the sum of sizes, 0 for an empty table."""
    return objects.agg(F.coalesce(F.max(key), F.lit(0)).alias("last_id"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def minimal_record(records: DataFrame) -> DataFrame:
    """The fields a caller sees, and of text_path and text_status exactly one.

    records: the fields, extract_path, and download_status. Without an extract the status says why:
    extract_failed, download_failed and metadata_only are final, all else is pending.
    """
    path = F.when(F.coalesce("extract_path", F.lit("")) != "", F.col("extract_path"))
    why = F.when(F.col("download_status") == "extract_failed", "extract_failed").when(F.col("download_status") == "failed", "download_failed").when(F.col("download_status") == "metadata_only", "metadata_only").otherwise("pending")
    fields = ["key", "title", "authors", "year", "venue", "abstract", "doi", "arxiv_id", "citation_count"]
    return records.select(*fields, path.alias("text_path"), F.when(path.isNull(), why).alias("text_status"))


def eligible_record(domain_status: Column, merge_intent: Column, quarantine: Column, merge: Column, alias_key: Column, policy_ok: Column) -> Column:
    """Whether a build may use a record: undecided in domain and merge, canonical, not quarantined nor an alias, allowed by policy."""
    state = ~F.coalesce(quarantine, F.lit(True)) & F.coalesce(merge == "canonical", F.lit(False)) & F.coalesce(alias_key, F.lit("")).eqNullSafe("")
    return domain_status.isNull() & merge_intent.isNull() & state & F.coalesce(policy_ok, F.lit(False))


# Joins of the catalog


def current_inventories(heads: DataFrame, inventories: DataFrame) -> DataFrame:
    """Inventories that are current: by parent and revision together. heads, inventories: (parent_unit_id, inventory_revision, ...)."""
    return inventories.join(heads.select("parent_unit_id", "inventory_revision").distinct(), ["parent_unit_id", "inventory_revision"])


def unregistered_records(records: DataFrame, units: DataFrame) -> DataFrame:
    """Records no unit stands for. units: (record_key)."""
    return records.join(units.select(F.col("record_key").alias("key")).distinct(), "key", "left_anti")


def pending_repairs(repairs: DataFrame, publications: DataFrame, selections: DataFrame, generations: DataFrame, limit: int = 100) -> DataFrame:
    """The oldest repairs of publications selected in an active generation, not yet made for its manifest.

    repairs: (repair_id, publication_id, target_generation, created_at); publications: (publication_id,
    derivation_id); selections: (derivation_id, generation_id); generations: (generation_id, state,
    manifest_revision, source_manifest_revision).
    """
    active = generations.where("state = 'active'").select("generation_id", "manifest_revision")
    target = generations.select(F.col("generation_id").alias("target_generation"), "source_manifest_revision")
    # a derivation's selections count by manifest: the first `limit` rows need no row for each of them
    picked = selections.join(active, "generation_id").groupBy("derivation_id", "manifest_revision").agg(F.count("*").alias("_n"))
    rows = repairs.join(publications, "publication_id").join(picked, "derivation_id").join(target, "target_generation", "left")
    open_ = rows.where(F.col("target_generation").isNull() | (F.col("source_manifest_revision") != F.col("manifest_revision")))
    first = open_.orderBy("created_at", "repair_id").limit(limit).select(*repairs.columns, F.explode(F.sequence(F.lit(1), F.least("_n", F.lit(limit)))).alias("_i"))
    return first.orderBy("created_at", "repair_id").limit(limit).select(*repairs.columns)


def reconcilable_receipts(jobs: DataFrame, attempts: DataFrame, receipts: DataFrame, operations: DataFrame, limit: int = 1000) -> DataFrame:
    """(receipt_id, receipt) of distillation jobs under way or done whose publication has not been recorded, oldest first.

    jobs: (id, kind, state, current_attempt_id, enqueued_at); attempts: (attempt_id, receipt_id);
    receipts: (receipt_id, receipt); operations: (operation_id), 'publish:' and the receipt for a publication.
    """
    done = operations.select(F.col("operation_id").alias("_op"))
    running = jobs.where("kind = 'distill' AND state IN ('running', 'succeeded')")
    rows = running.join(attempts, F.col("current_attempt_id") == F.col("attempt_id")).join(receipts, "receipt_id")
    return rows.join(done, F.concat(F.lit("publish:"), F.col("receipt_id")) == F.col("_op"), "left_anti").orderBy("enqueued_at", "id").limit(limit).select("receipt_id", "receipt")


def selected_receipts(selections: DataFrame, derivations: DataFrame, receipts: DataFrame, generations: DataFrame, units: DataFrame) -> DataFrame:
    """(unit_id, generation_id, receipt) selected in an active or candidate generation."""
    live = generations.where("state IN ('active', 'candidate')").select("generation_id")
    return selections.join(live, "generation_id").join(units.select("unit_id"), "unit_id").join(derivations.select("derivation_id", "receipt_id"), "derivation_id").join(receipts, "receipt_id").select("unit_id", "generation_id", "receipt")


def collection_heads(generations: DataFrame, manifests: DataFrame, receipts: DataFrame) -> DataFrame:
    """(generation_id, receipt): the receipt of the last layer of each live generation's manifest.

    manifests: (generation_id, manifest_revision, aggregate_layers); receipts: (namespace, receipt).
    """
    live = generations.where("state IN ('active', 'candidate')").select("generation_id", "manifest_revision")
    heads = live.join(manifests, ["generation_id", "manifest_revision"]).where(F.size("aggregate_layers") > 0).withColumn("namespace", F.element_at("aggregate_layers", -1))
    return heads.join(receipts, "namespace").select("generation_id", "receipt")


def admission_jobs(t: Mapping[str, DataFrame], now: Column) -> DataFrame:
    """(job_id, unit_id, generation_id) that may be claimed now, in the order they were queued.

    t: jobs (id, unit_id, kind, state, quarantine, target_generation, consumed_input_revision,
    recipe_digest, current_attempt_id, enqueued_at), requirements (unit_id, generation_id, invalidated,
    excluded, enqueue_mode, record_revision, inventory_revision, consumed_input_revision, recipe_digest),
    generations (generation_id, state, manifest_revision, retrieval_contract), units (unit_id, kind, record_key, quarantine),
    inputs (consumed_input_revision, mapping_revision, parent_evidence_revision, tier), recipes
    (recipe_digest, outputs: map of a tier to what it needs, embedding), records (key, policy, merge,
    quarantine, revision), attempts (attempt_id, receipt_id, lease_expires_at, base_revision), operations
    (operation_id), reducers (unit_id, consumed_input_revision, parked), mappings (unit_id,
    mapping_revision, parent_unit_id, parent_evidence_revision), heads (parent_unit_id, generation_id,
    inventory_revision, invalidated, record_revision), inventories (parent_unit_id, inventory_revision,
    mode, mapping_revisions: map, units: array, parent_evidence_revision), windows (starts_at, ends_at).
    """
    def renamed(name: str, prefix: str) -> DataFrame:
        return t[name].select(*[F.col(c).alias(f"{prefix}_{c}") for c in t[name].columns])

    j = t["jobs"].where("kind = 'distill' AND NOT quarantine")
    q = t["requirements"].where("NOT invalidated AND NOT excluded").withColumnRenamed("generation_id", "target_generation")
    rows = j.join(q, ["unit_id", "target_generation", "consumed_input_revision", "recipe_digest"])
    rows = rows.join(renamed("generations", "g"), F.col("target_generation") == F.col("g_generation_id"))
    rows = rows.join(renamed("units", "u").where("NOT u_quarantine"), F.col("unit_id") == F.col("u_unit_id"))
    rows = rows.join(renamed("inputs", "i"), F.col("consumed_input_revision") == F.col("i_consumed_input_revision"))
    rows = rows.join(renamed("recipes", "p"), F.col("recipe_digest") == F.col("p_recipe_digest"))
    rows = rows.join(renamed("records", "r"), F.col("u_record_key") == F.col("r_key"), "left")
    rows = rows.join(renamed("attempts", "a"), F.col("current_attempt_id") == F.col("a_attempt_id"), "left")
    rows = rows.join(renamed("operations", "o"), F.concat(F.lit("publish:"), F.col("a_receipt_id")) == F.col("o_operation_id"), "left")
    rows = rows.join(renamed("reducers", "c"), (F.col("unit_id") == F.col("c_unit_id")) & (F.col("consumed_input_revision") == F.col("c_consumed_input_revision")), "left")
    rows = rows.join(renamed("mappings", "m"), (F.col("unit_id") == F.col("m_unit_id")) & (F.col("m_mapping_revision") == F.col("i_mapping_revision")), "left")
    rows = rows.join(renamed("units", "v"), F.col("m_parent_unit_id") == F.col("v_unit_id"), "left")
    rows = rows.join(renamed("records", "w"), F.col("v_record_key") == F.col("w_key"), "left")
    rows = rows.join(renamed("heads", "h"), (F.col("v_unit_id") == F.col("h_parent_unit_id")) & (F.col("target_generation") == F.col("h_generation_id")), "left")
    rows = rows.join(renamed("inventories", "n"), (F.col("h_parent_unit_id") == F.col("n_parent_unit_id")) & (F.col("h_inventory_revision") == F.col("n_inventory_revision")), "left")
    open_window = t["windows"].agg(F.coalesce(F.bool_or((F.col("starts_at") <= now) & (F.col("ends_at") > now)), F.lit(False)).alias("_open"))
    rows = rows.crossJoin(F.broadcast(open_window))  # one row

    def fine(p: str, revision: str) -> Column:
        """No record, or one that may be served in the revision asked for."""
        ok = F.col(f"{p}_policy").isin("clear", "override") & (F.col(f"{p}_merge") == "canonical") & ~F.col(f"{p}_quarantine") & (F.col(revision) == F.col(f"{p}_revision"))
        return F.coalesce(ok, F.lit(False))

    candidate = F.col("g_state") == "candidate"
    generation = (F.col("g_state") == "active") & (F.col("enqueue_mode") == "active") | (candidate & F.col("_open"))
    own_record = F.col("u_record_key").isNull() | fine("r", "record_revision")
    section = (
        F.col("v_unit_id").isNotNull() & ~F.col("v_quarantine") & ~F.col("h_invalidated") & (F.col("h_inventory_revision") == F.col("inventory_revision")) & (F.col("n_mode") == "sections")
        & (F.element_at("n_mapping_revisions", F.col("u_unit_id")) == F.col("m_mapping_revision")) & F.array_contains("n_units", F.col("u_unit_id"))
        & (F.col("n_parent_evidence_revision") == F.col("m_parent_evidence_revision")) & (F.col("i_parent_evidence_revision") == F.col("m_parent_evidence_revision"))
        & (F.col("v_record_key").isNull() | fine("w", "h_record_revision"))
    )
    vectors = F.arrays_overlap(F.element_at("p_outputs", F.coalesce("i_tier", F.lit("fulltext"))), F.array(*map(F.lit, ("vectors", "chunks_vdb", "entities_vdb", "relationships_vdb"))))
    contract = ~F.coalesce(vectors, F.lit(False)) | (F.col("p_embedding").isNotNull() & (F.col("g_retrieval_contract").isNull() | (F.col("g_retrieval_contract") == F.col("p_embedding"))))
    stale = (F.col("state") == "succeeded") & F.col("o_operation_id").isNull() & (F.col("a_base_revision") != F.col("g_manifest_revision"))
    claimable = F.col("state").isin("queued", "failed") | ((F.col("state") == "running") & (F.col("a_lease_expires_at") <= now)) | stale
    conditions = [generation, own_record, (F.col("u_kind") != "section") | section, contract, claimable, ~F.coalesce("c_parked", F.lit(False))]
    for c in conditions:
        rows = rows.where(F.coalesce(c, F.lit(False)))
    return rows.orderBy("enqueued_at", "id").select(F.col("id").alias("job_id"), "unit_id", F.col("target_generation").alias("generation_id"))


# Sets


def protected_namespaces(manifests: DataFrame, derivations: DataFrame, receipts: DataFrame, pins: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """Every namespace that something still needs, once: layers of manifests and of derivations' receipts, pins in force, attempts open or of unknown cost."""
    def layers(df: DataFrame, column: str) -> DataFrame:
        return df.select(F.explode(column).alias("namespace"))

    held = layers(receipts.join(derivations.select("receipt_id"), "receipt_id", "left_semi"), "aggregate_layers")
    pinned = layers(pins.where(F.col("released_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))), "namespaces")
    tried = attempts.where("outcome IS NULL OR cost_state = 'unknown'").select("namespace")
    return layers(manifests, "aggregate_layers").union(held).union(pinned).union(tried).where("namespace IS NOT NULL").distinct()


def live_inputs(requirements: DataFrame, generations: DataFrame, jobs: DataFrame) -> DataFrame:
    """Input revisions that a live generation requires or an open distillation job consumes, once each."""
    live = generations.where("state IN ('active', 'candidate')").select("generation_id")
    wanted = requirements.where("NOT excluded").join(live, "generation_id", "left_semi").select("consumed_input_revision")
    return wanted.union(jobs.where("kind = 'distill' AND state IN ('queued', 'running')").select("consumed_input_revision")).distinct()


def set_report(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, part): both, left or right, each key of either side once."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.intersect(b).withColumn("part", F.lit("both")).unionByName(a.subtract(b).withColumn("part", F.lit("left"))).unionByName(b.subtract(a).withColumn("part", F.lit("right")))


# Writes


def alias_delta(records: DataFrame, aliases: DataFrame, changed: DataFrame, new_aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, aliases, problems) after a batch: the aliases of its records are replaced first, then the records themselves.

    records, changed: (key, payload); aliases, new_aliases: (key, target). problems: (key, reason), with
    `cycle` for an alias in a cycle, `dangling` for one that leads to no record; with any the batch is not to
    be published.
    """
    kept = aliases.join(changed.select(F.col("key").alias("target")).distinct(), "target", "left_anti").select("key", "target")
    after = kept.join(new_aliases.select("key"), "key", "left_anti").unionByName(new_aliases.select("key", "target"))
    rows = records.join(changed.select("key"), "key", "left_anti").unionByName(changed).join(after.select("key"), "key", "left_anti")
    roots = alias_chase(after)
    cycles = roots.where("is_cycle").select("key", F.lit("cycle").alias("reason"))
    loose = roots.where("NOT is_cycle").join(rows.select(F.col("key").alias("root")), "root", "left_anti").select("key", F.lit("dangling").alias("reason"))
    return rows, after, cycles.unionByName(loose)


def filled_identifiers(records: DataFrame, found: DataFrame, column: str = "doi") -> DataFrame:
    """(key, value, outcome): an identifier found for a record fills a blank one if no other record owns it.

    outcome: filled, kept (the record has one), owned (another record has it), contested (two records were
    given it). found: (key, value).
    """
    own = F.lower(F.trim(F.coalesce(column, F.lit(""))))
    owners = records.where(own != "").groupBy(own.alias("_v")).agg(F.min("key").alias("_owner"))
    asked = found.select("key", F.lower(F.trim("value")).alias("_v"), "value").where("_v <> ''")
    rivals = asked.groupBy("_v").agg(F.count_distinct("key").alias("_n"))
    both = asked.join(records.select("key", own.alias("_own")), "key").join(owners, "_v", "left").join(rivals, "_v")
    outcome = F.when(F.col("_own") != "", "kept").when(F.col("_owner").isNotNull(), "owned").when(F.col("_n") > 1, "contested").otherwise("filled")
    return both.select("key", "value", outcome.alias("outcome"))


def ledger_upsert(ledger: DataFrame, writes: DataFrame) -> DataFrame:
    """(source, source_id, doc_id, status, fingerprint) after a write a key: the newest status, the old fingerprint where the new is null."""
    new = writes.select("source", "source_id", *[F.col(c).alias(f"_{c}") for c in ("doc_id", "status", "fingerprint")])
    both = ledger.join(new, ["source", "source_id"], "full_outer")
    return both.select("source", "source_id", F.coalesce("_doc_id", "doc_id").alias("doc_id"), F.coalesce("_status", "status").alias("status"), F.coalesce("_fingerprint", "fingerprint").alias("fingerprint"))


def append_only_breaches(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, breach): rows of an append-only table that are gone or have changed."""
    rest = [c for c in before.columns if c != key]
    both = before.select(key, F.struct(*rest).alias("_a")).join(after.select(key, F.struct(*rest).alias("_b"), F.lit(True).alias("_there")), key, "left")
    return both.select(key, F.when(F.col("_there").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed").alias("breach")).where("breach IS NOT NULL")


def replayed(initial: DataFrame, journal: DataFrame) -> DataFrame:
    """(row_id, sequence, state, problem): each row's last image after a snapshot and its journal, and the first breach in its history.

    initial: (row_id, image); journal: (sequence, row_id, operation, old_image, new_image). An old image
    must equal the image before it; an INSERT must find none, another operation one: else problem is
    conflict, present or absent. state is null for a deleted row.
    """
    start = initial.select("row_id", F.lit(0).cast("long").alias("sequence"), F.lit("SNAPSHOT").alias("operation"), F.lit(None).cast("string").alias("old_image"), F.col("image").alias("new_image"))
    every = start.unionByName(journal.select("row_id", F.col("sequence").cast("long").alias("sequence"), "operation", "old_image", F.when(F.col("operation") != "DELETE", F.col("new_image")).alias("new_image")))
    w = Window.partitionBy("row_id").orderBy("sequence")
    before = F.lag("new_image").over(w)
    problem = F.when(F.col("operation") == "SNAPSHOT", None).when((F.col("operation") == "INSERT") & before.isNotNull(), "present").when((F.col("operation") != "INSERT") & before.isNull(), "absent").when((F.col("operation") != "INSERT") & ~before.eqNullSafe(F.col("old_image")), "conflict")
    checked = every.withColumn("problem", problem)
    return checked.groupBy("row_id").agg(F.max("sequence").alias("sequence"), F.max_by("new_image", "sequence").alias("state"), F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("sequence"))).alias("problem"))


def replay_closure(heads: DataFrame, inventories: DataFrame, requirements: DataFrame, inputs: DataFrame, recipes: DataFrame, generation: str, parents: DataFrame | None = None) -> DataFrame:
    """(kind, id): the units, inputs and recipes a replay of a generation's parents needs, `missing` before the kind of those not there.

    heads: (parent_unit_id, generation_id, inventory_revision); inventories: (parent_unit_id,
    inventory_revision, units, parent_input); requirements: (unit_id, generation_id,
    consumed_input_revision, recipe_digest).
    """
    own = heads.where(F.col("generation_id") == generation)
    own = own if parents is None else own.join(parents.select("parent_unit_id").distinct(), "parent_unit_id", "left_semi")
    inv = inventories.join(own.select("parent_unit_id", "inventory_revision"), ["parent_unit_id", "inventory_revision"], "left_semi")
    units = own.select(F.col("parent_unit_id").alias("unit_id")).union(inv.select(F.explode("units").alias("unit_id"))).distinct()
    req = requirements.where(F.col("generation_id") == generation).join(units, "unit_id", "left_semi")
    need_in = req.select(F.col("consumed_input_revision").alias("id")).union(inv.where("parent_input IS NOT NULL").select("parent_input")).distinct()
    need_re = req.select(F.col("recipe_digest").alias("id")).distinct()

    def found(need: DataFrame, there: DataFrame, column: str, kind: str) -> DataFrame:
        both = need.join(there.select(F.col(column).alias("id"), F.lit(True).alias("_t")).distinct(), "id", "left")
        return both.select(F.when(F.col("_t"), kind).otherwise(f"missing {kind}").alias("kind"), "id")

    return units.select(F.lit("unit").alias("kind"), F.col("unit_id").alias("id")).unionByName(found(need_in, inputs, "consumed_input_revision", "input")).unionByName(found(need_re, recipes, "recipe_digest", "recipe"))


# Reports


def queue_report(records: DataFrame) -> DataFrame:
    """(measure, n): records by status (blank as other), and of those that are ok how many have which extract. records: (download_status, has_md, has_txt)."""
    bucket = F.when(F.coalesce("download_status", F.lit("")) == "", "other").otherwise(F.col("download_status"))
    ok = F.col("download_status") == "ok"
    counts = records.groupBy(F.concat(F.lit("status:"), bucket).alias("measure")).agg(F.count("*").alias("n"))
    tests = {"ok_total": ok, "ok_has_md": ok & F.col("has_md"), "ok_has_txt": ok & F.col("has_txt"), "ok_missing_both": ok & ~F.col("has_md") & ~F.col("has_txt")}
    sums = records.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in tests.items()])
    return counts.unionByName(sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("n")) for k in tests])).alias("m")).select("m.*"))


def recent_failed(records: DataFrame, n: int = 10) -> DataFrame:
    """The failed records added last, ties by key."""
    return records.where("download_status = 'failed'").orderBy(F.coalesce("added_at", F.lit("")).desc(), "key").limit(n).select("key", "doi", "arxiv_id", "added_at")


def audit(records: DataFrame, files: DataFrame) -> DataFrame:
    """(problem, key, kind): drift (a file the record does not name), dangling (a name without a file), orphan (a file without a record).

    records: (key, kind, path); files: (key, kind), one row for each file.
    """
    there = files.select("key", "kind").distinct().withColumn("_f", F.lit(True))
    both = records.join(there, ["key", "kind"], "left")
    named = F.coalesce("path", F.lit("")) != ""
    own = both.select(F.when(F.col("_f") & ~named, "drift").when(F.col("_f").isNull() & named, "dangling").alias("problem"), "key", "kind").where("problem IS NOT NULL")
    orphans = there.join(records.select("key").distinct(), "key", "left_anti").select(F.lit("orphan").alias("problem"), "key", "kind")
    return own.unionByName(orphans)


def backfilled_paths(records: DataFrame, files: DataFrame) -> DataFrame:
    """(key, kind, path): paths for records that name none though the file is there; never an overwrite. files: (key, kind, path)."""
    blank = records.where(F.trim(F.coalesce("path", F.lit(""))) == "").select("key", "kind")
    return blank.join(files.select("key", "kind", "path"), ["key", "kind"])


def route_counts(rows: DataFrame, route: Column, batch: int, canaries: int, deferred: Column) -> DataFrame:
    """(route, n, taken, held): of each route its rows, those a sweep takes, at most `batch` in order of key, and those held back.

    Deferred rows are held but for the first `canaries` of a route, which show whether their cause has gone.
    """
    marked = rows.select(route.alias("route"), F.coalesce(deferred, F.lit(False)).alias("_d"))
    counts = marked.groupBy("route").agg(F.count("*").alias("n"), F.count_if("_d").alias("_held"))
    can = F.col("n") - F.col("_held") + F.least("_held", F.lit(canaries))
    return counts.select("route", "n", F.least(can, F.lit(batch)).alias("taken"), (F.col("n") - can).alias("held"))


def routes_taken(rows: DataFrame, route: Column, batch: int, canaries: int, deferred: Column) -> DataFrame:
    """(route, place, key): the rows that a sweep takes, as route_counts() counts them; tasks keep the first of each route before the shuffle."""
    marked = rows.select("key", route.alias("route"), F.coalesce(deferred, F.lit(False)).alias("_d"))
    held = ranked(marked.where("_d"), ["route"], [F.col("key")], "_n", canaries).drop("_n")
    return ranked(marked.where("NOT _d").unionByName(held), ["route"], [F.col("key")], "place", batch).select("route", "place", "key")


def deferred_extract(signature: Column, now_signature: Column, epoch: Column, success_epoch: Column) -> Column:
    """Whether an extract stays deferred: it was, its file is the same, and nothing has succeeded since."""
    return signature.isNotNull() & signature.eqNullSafe(now_signature) & F.coalesce(epoch, F.lit(0)).eqNullSafe(success_epoch)


def identity_backfill(records: DataFrame, most: int) -> DataFrame:
    """(route, n): how a bounded, ordered choice of records without an identifier could get one: by arxiv_id, by title, or not at all."""
    def blank(c: str) -> Column:
        return F.trim(F.coalesce(c, F.lit(""))) == ""

    chosen = records.where(blank("doi")).orderBy("key").limit(most)
    return chosen.groupBy(F.when(~blank("arxiv_id"), "arxiv").when(~blank("title"), "title").otherwise("none").alias("route")).agg(F.count("*").alias("n"))


def coverage_totals(members: DataFrame, fields: Sequence[str] = ("registered", "readable", "published", "indexed"), tiers: Sequence[str] = ("fulltext", "abstract", "metadata")) -> DataFrame:
    """One row: records that reach each state and units covered in each tier. members: (record, unit, kind, tier, covered, the states).

    A record is registered if a unit of it is; the other states are those of its one unit that is no
    section, false without exactly one.
    """
    parent = F.col("kind") != "section"
    single = F.count_if(parent) == 1
    state = [F.bool_or("registered").alias("registered"), *[(single & F.coalesce(F.bool_or(parent & F.col(c)), F.lit(False))).alias(c) for c in fields if c != "registered"]]
    counts = [F.count_if(F.col("covered") & (F.col("tier") == x)).alias(f"tier_{x}") for x in tiers]
    per = members.groupBy("record").agg(*state, *counts)
    return per.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(c) for c in fields], *[F.coalesce(F.sum(f"tier_{x}"), F.lit(0)).alias(f"tier_{x}") for x in tiers])


def unit_coverage(units: DataFrame) -> DataFrame:
    """(unit, registered, readable, published, indexed, reasons): a unit's states and, in order, why it falls short.

    units: (unit, record_ok, extract_ok, receipt_ok, stale, quarantine, roles_ok). Each state needs the one before.
    """
    def yes(c: str) -> Column:
        return F.coalesce(c, F.lit(False))

    registered = yes("record_ok") & ~F.coalesce("quarantine", F.lit(False))
    readable = registered & yes("extract_ok")
    published = readable & yes("receipt_ok") & ~F.coalesce("stale", F.lit(True))
    indexed = published & yes("roles_ok")
    tests = {"unregistered": ~yes("record_ok"), "quarantined": F.coalesce("quarantine", F.lit(False)), "unreadable": ~yes("extract_ok"), "no_receipt": ~yes("receipt_ok"), "stale_receipt": yes("receipt_ok") & F.coalesce("stale", F.lit(True)), "missing_outputs": ~yes("roles_ok")}
    reasons = F.array_compact(F.array(*[F.when(bad, name) for name, bad in tests.items()]))
    return units.select("unit", registered.alias("registered"), readable.alias("readable"), published.alias("published"), indexed.alias("indexed"), reasons.alias("reasons"))


def serving_entries(desired: DataFrame, covered: DataFrame) -> DataFrame:
    """(unit_id, derivation_id, eligible, reason) of a pinned manifest's entries under the coverage of the moment.

    desired: (unit_id, selected_derivation_id, excluded); covered: (unit_id, derivation_id, source_eligible,
    tier_covered, achieved_tier, readable, quarantine, excluded).
    """
    c = covered.withColumnsRenamed({"excluded": "_x"})
    both = desired.join(c, "unit_id", "left")

    def yes(name: str) -> Column:
        return F.coalesce(name, F.lit(False))

    fits = ~yes("excluded") & F.col("derivation_id").eqNullSafe(F.col("selected_derivation_id")) & yes("source_eligible") & yes("tier_covered") & ~yes("quarantine") & ~yes("_x") & (~F.col("achieved_tier").eqNullSafe("fulltext") | yes("readable"))
    return both.select("unit_id", F.col("selected_derivation_id").alias("derivation_id"), fits.alias("eligible"), F.when(fits, "verified_current").otherwise("ineligible_or_unavailable").alias("reason"))


def consistent_receipt(receipts: DataFrame, by: str, fields: Sequence[str]) -> DataFrame:
    """One row a group with the fields on which all its receipts must agree; a group that disagrees raises."""
    out = receipts.groupBy(by).agg(F.min(F.struct(*fields)).alias("_f"), F.min(F.struct(*fields)).eqNullSafe(F.max(F.struct(*fields))).alias("_same"))
    checked = F.when(F.col("_same"), F.col("_f")).otherwise(F.raise_error(F.concat(F.lit("receipts disagree for "), F.col(by).cast("string"))).cast(out.schema["_f"].dataType))
    return out.select(by, checked.alias("_f")).select(by, "_f.*")


def shape_problems(rows: DataFrame, key: str, required: Mapping[str, str], document: str = "document") -> DataFrame:
    """(key, problems): fields of a JSON document that are missing, of another type, or not asked for.

    required: field to number, string, boolean, array or object.
    """
    kinds = {"number": "^-?[0-9]", "string": '^"', "boolean": "^(true|false)$", "array": r"^\[", "object": r"^\{"}
    parts = F.from_json(F.col(document), "map<string,string>")
    raw = {f: F.get_json_object(F.col(document), f"$['{f}']") for f in required}
    names = F.coalesce(F.json_object_keys(document), F.array().cast("array<string>"))
    missing = [F.when(~F.array_contains(names, f), F.lit(f"missing {f}")) for f in required]
    wrong = [F.when(F.array_contains(names, f) & (raw[f].isNull() | (~raw[f].rlike(kinds[k]) if k != "string" else F.lit(False))), F.lit(f"wrong {f}")) for f, k in required.items()]
    extra = F.transform(F.array_except(names, F.array(*map(F.lit, required))), lambda x: F.concat(F.lit("unknown "), x))
    problems = F.concat(F.array_compact(F.array(*missing, *wrong)), F.array_sort(extra))
    return rows.select(key, F.when(parts.isNull(), F.array(F.lit("not an object"))).otherwise(problems).alias("problems")).where(F.size("problems") > 0)


# Names and identities


def provenance_key(kind: Column, key: Column, forms: Mapping[str, str]) -> Column:
    """struct<source, source_id> of a key '<kind>:<body>' whose body has its kind's form; null for any other. forms: kind to pattern."""
    body = F.regexp_extract(key, "^[^:]*:(.*)$", 1)
    ok = F.lit(False)
    for name, form in forms.items():
        ok = ok | ((kind == name) & key.startswith(f"{name}:") & body.rlike(form))
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(kind.alias("source"), body.alias("source_id")))


def without_section(path: Column) -> Column:
    """A path without the number of its section."""
    return F.regexp_replace(path, r"#s\d+$", "")


def identity_values(values: Column) -> Column:
    """Distinct values, trimmed, in the order they came; blanks are none."""
    flat = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    return F.array_distinct(flat)


def bare_dois(values: Column) -> Column:
    return F.array_distinct(F.transform(identity_values(values), lambda x: F.regexp_replace(x, r"(?i)^(?:doi:|https?://(?:dx\.)?doi\.org/)", "")))


def bare_arxiv(values: Column) -> Column:
    return F.array_distinct(F.transform(identity_values(values), lambda x: F.regexp_replace(x, r"(?i)^(?:arxiv:|oai:arxiv\.org:|https?://arxiv\.org/abs/)", "")))


def clean_urls(values: Column) -> Column:
    """http and https addresses with a host, no user and no white space."""
    return F.filter(identity_values(values), lambda x: x.rlike(r"^https?://[^/\s@?#:]+(?::[0-9]+)?(?:[/?#]\S*)?$"))


def merged_identities(observations: DataFrame, by: str, fields: Sequence[str], order: str) -> DataFrame:
    """(by, identities): each distinct observation once, in the order it was first made; conflicting ones all stay."""
    first = observations.groupBy(by, F.struct(*fields).alias("o")).agg(F.min(order).alias("at"))
    sorted_ = F.array_sort(F.collect_list(F.struct("at", "o")))
    return first.groupBy(by).agg(F.transform(sorted_, lambda x: x["o"]).alias("identities"))


def requests_joined(requests: DataFrame, retention: float = 900.0) -> DataFrame:
    """(request_id, leader): requests for one query share the work of the first, while it runs and until `retention` seconds after its end.

    requests: (request_id, query, at, seconds); seconds is how long a request's work takes if it is done, null while it has
    not ended. Queries are told apart by their text without outer white space: case and inner spaces count. The first request
    after a result has gone leads anew; of requests at one moment the smallest id. A blank query is answered at once: leader null.

    A query's requests pass through a task in order of time, of which it keeps the leader alone.
    """
    q = F.regexp_replace("query", r"^\s+|\s+$", "")
    at = F.col("at").cast("double")
    rows = requests.select("request_id", F.coalesce(q, F.lit("")).alias("q"), at.alias("at"), (at + F.col("seconds") + retention).alias("until"))
    kind = requests.schema["request_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query, leader, until = None, None, 0.0
        for batch in batches:
            leaders = []
            for i, q, at, ends in batch.itertuples(index=False):
                if q != query or at >= until:
                    query, leader, until = q, i, float("inf") if pd.isna(ends) else ends
                leaders.append(leader if q else None)
            yield pd.DataFrame({"request_id": batch["request_id"], "leader": pd.Series(leaders, dtype=object)})

    return rows.repartition("q").sortWithinPartitions("q", "at", "request_id").mapInPandas(run, f"request_id {kind}, leader {kind}")


def work_order(tasks: DataFrame, lanes: int) -> DataFrame:
    """(task_id, lane, place): tasks by priority, then age, then id, dealt to lanes in turn; a key that is queued twice stands once, at its best."""
    once = tasks.groupBy("key").agg(F.min(F.struct("priority", "queued_at", "task_id")).alias("t")).select("t.*")
    order = ranked_all(once, [F.col("priority"), F.col("queued_at"), F.col("task_id")], "n")
    return order.select("task_id", (F.col("n") % lanes).alias("lane"), F.floor(F.col("n") / lanes).cast("int").alias("place"))
