"""Snapshot diffs, change capture, reconciliation and retention plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a task of a digest gets, about.
TASK_ROWS = 200_000


def snapshot_diff(index: DataFrame, ledger: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """(key, action): distill new keys, redistill changed or failed ones, remove keys that left the index.

    index: (key, fingerprint); ledger: (key, fingerprint, status). Unchanged keys give no row, parked
    ones only when their fingerprint changed. A subset of keys narrows both sides first.
    """
    if subset is not None:
        only = subset.select("key").distinct()
        index, ledger = index.join(only, "key", "left_semi"), ledger.join(only, "key", "left_semi")
    a = index.select("key", F.col("fingerprint").alias("_new"), F.lit(True).alias("_in"))
    b = ledger.select("key", F.col("fingerprint").alias("_old"), "status", F.lit(True).alias("_had"))
    action = (
        F.when(F.col("_had").isNull(), "distill")
        .when(F.col("_in").isNull(), "remove")
        .when(~F.col("_new").eqNullSafe(F.col("_old")) | F.col("status").isin("error", "pending_remove"), "redistill")
    )
    return a.join(b, "key", "full_outer").select("key", action.alias("action")).where("action IS NOT NULL")


def twin_adoption(ledger: DataFrame) -> DataFrame:
    """(source, source_id, twin_doc): rows without a document whose fingerprint a processed row has; the first by (source, source_id)."""
    done = ledger.where("status = 'done' AND processed AND fingerprint IS NOT NULL AND fingerprint <> 'META'")
    twins = done.groupBy("fingerprint").agg(F.min_by("doc_id", F.struct("source", "source_id")).alias("twin_doc"))
    return ledger.where(~F.coalesce("processed", F.lit(False))).join(twins, "fingerprint").select("source", "source_id", "twin_doc")


def write_back(ledger: DataFrame, states: DataFrame, stuck_after: int = 3) -> DataFrame:
    """Ledger rows with the document state taken over; a row still processing counts a round, and errs after stuck_after."""
    both = ledger.join(states.select("doc_id", F.col("state")), "doc_id", "left")
    waiting = F.coalesce(F.col("state"), F.lit("processing")) == "processing"
    rounds = F.when(waiting & (F.col("status") == "processing"), F.col("rounds") + 1).otherwise(F.lit(0))
    status = F.when(F.col("status") != "processing", F.col("status")).when(F.col("state") == "processed", "done").when(F.col("state") == "failed", "error").when(F.col("rounds") + 1 >= stuck_after, "error").otherwise("processing")
    return both.select("key", "doc_id", status.alias("status"), rounds.alias("rounds"))


def intra_dedup(rows: DataFrame, digest: Column, pos: str = "pos") -> DataFrame:
    """rows with duplicate_of: the key of the first row (by pos) with the same digest; null for that row and for null digests."""
    with_digest = rows.withColumn("_d", digest)
    first = with_digest.where("_d IS NOT NULL").groupBy("_d").agg(F.min_by("key", pos).alias("_first"))
    return with_digest.join(first, "_d", "left").withColumn("duplicate_of", F.when(F.col("_first") != F.col("key"), F.col("_first"))).drop("_d", "_first")


def change_delta(journal: DataFrame, after: int) -> DataFrame:
    """Changes with sequence above `after`, in order; a gap in the sequence raises when the result is read.

    Contiguity is checked by counts on the whole delta, not by an order in one task.
    """
    delta = journal.where(F.col("sequence") > after)
    sums = delta.agg(F.count_distinct("sequence").alias("n"), F.count("*").alias("rows"), F.max("sequence").alias("top"))
    fine = (F.col("rows") == 0) | ((F.col("n") == F.col("rows")) & (F.col("top") - after == F.col("n")))
    check = sums.select(F.when(fine, F.lit(True)).otherwise(F.raise_error(F.lit("the journal has a gap"))).alias("_ok"))
    return delta.crossJoin(F.broadcast(check)).where("_ok").drop("_ok")


def change_fold(journal: DataFrame, by: Sequence[str] = ("row_id",)) -> DataFrame:
    """The last image of each row that is not deleted: columns by and new_row."""
    last = journal.groupBy(*by).agg(F.max_by(F.struct("operation", "new_row"), "sequence").alias("c"))
    return last.where("c.operation <> 'DELETE'").select(*by, "c.new_row.*")


def state_digest(rows: DataFrame, key: str, payload: Column, leaf: int = 4096) -> DataFrame:
    """One sha256 over all rows, by a tree over the hashes of their keys, and n_rows.

    The tree has a digit of the hash a level, as many levels as keep some `leaf` rows under a node,
    so that no node grows with the table. Rows stand in the order of their keys' hashes, of equal
    keys in that of their payloads' hashes; payload hashes are part of the digest, null ones as such.
    Rows are hashed and sent to tasks of some TASK_ROWS, as hashes take far more room than what is read.
    """
    depth, n = 0, rows.count()
    while n > leaf << (4 * depth):
        depth += 1
    parts = -(-n // TASK_ROWS) or 1
    key_hash, payload_hash = (F.sha2(F.coalesce(c, F.lit("\x00")), 256) for c in (F.col(key).cast("string"), payload))
    level = rows.select(key_hash.alias("_k"), payload_hash.alias("_h")).select(F.substring("_k", 1, depth).alias("_node"), F.unhex("_k").alias("_k"), F.unhex("_h").alias("_h"))
    level = level.repartition(parts, "_node")  # before lists are gathered, which no task then does for all that it reads
    level = level.select("_node", F.lower(F.hex("_k")).alias("_k"), F.lower(F.hex("_h")).alias("_h"), F.lit(1).cast("long").alias("_n"))
    for digits in range(depth, -1, -1):
        child = F.concat(F.col("_k"), F.lit("="), F.col("_h"))
        joined = F.sha2(F.array_join(F.array_sort(F.collect_list(child)), "\n"), 256)
        level = level.groupBy("_node").agg(joined.alias("_h"), F.sum("_n").alias("_n")).select(F.substring("_node", 1, max(digits - 1, 0)).alias("_node"), F.col("_node").alias("_k"), "_h", "_n")
    return level.agg(F.coalesce(F.max("_h"), F.sha2(F.lit(""), 256)).alias("digest"), F.sum("_n").alias("n_rows"))


def catalog_compare(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Per key of either side: where it is, and the fields that differ, in the order given."""
    a = left.select(key, *[F.col(f).alias(f"_a_{f}") for f in fields], F.lit(True).alias("_a"))
    b = right.select(key, *[F.col(f).alias(f"_b_{f}") for f in fields], F.lit(True).alias("_b"))
    both = a.join(b, key, "full_outer")
    side = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("both")
    different = F.array_compact(F.array(*[F.when(~F.col(f"_a_{f}").eqNullSafe(F.col(f"_b_{f}")), f) for f in fields]))
    return both.select(key, side.alias("side"), F.when(side == "both", different).otherwise(F.array().cast("array<string>")).alias("differs"))


def three_way_merge(rows: DataFrame, fields: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Per field base, local and remote merged to one; conflict if both changed a field, or a field outside `allowed` changed."""
    conflict = F.lit(False)
    out = []
    for f in fields:
        base, local, remote = (F.col(f"{p}_{f}") for p in ("base", "local", "remote"))
        mine, theirs = ~local.eqNullSafe(base), ~remote.eqNullSafe(base)
        conflict = conflict | (mine & theirs & ~local.eqNullSafe(remote)) | ((mine | theirs) & F.lit(f not in allowed))
        out.append(F.when(mine, local).otherwise(remote).alias(f))
    return rows.select("key", *out, conflict.alias("conflict"))


def fill_blanks(existing: DataFrame, incoming: DataFrame, key: str, text: Sequence[str], counts: Sequence[str] = (), flags: Sequence[str] = ()) -> DataFrame:
    """Merge by key: text that is there wins over new text, counts take the larger, flags either."""
    other = incoming.select(key, *[F.col(c).alias(f"_n_{c}") for c in (*text, *counts, *flags)])
    both = existing.join(other, key, "full_outer")
    return both.select(
        key,
        *[F.coalesce(F.when(F.trim(c) != "", F.col(c)), F.col(f"_n_{c}"), F.col(c)).alias(c) for c in text],
        *[F.greatest(c, f"_n_{c}").alias(c) for c in counts],
        *[(F.coalesce(c, F.lit(False)) | F.coalesce(f"_n_{c}", F.lit(False))).alias(c) for c in flags],
    )


def optimistic_upsert(current: DataFrame, writes: DataFrame) -> DataFrame:
    """(key, outcome, payload, revision): inserted, unchanged, updated or stale, by the revision a write expects.

    current: (key, payload, revision); writes: (key, payload, expected), one per key, expected 0 for new rows.
    """
    both = current.join(writes.select("key", F.col("payload").alias("_p"), "expected"), "key", "full_outer")
    outcome = (
        F.when(F.col("expected").isNull(), "kept").when(F.col("revision").isNull() & (F.col("expected") == 0), "inserted")
        .when(F.col("revision").isNull() | (F.col("revision") != F.col("expected")), "stale").when(F.col("payload").eqNullSafe(F.col("_p")), "unchanged").otherwise("updated")
    )
    wins = F.col("outcome").isin("inserted", "updated")
    return both.withColumn("outcome", outcome).select("key", "outcome", F.when(wins, F.col("_p")).otherwise(F.col("payload")).alias("payload"), F.when(wins, F.coalesce("revision", F.lit(0)) + 1).otherwise(F.col("revision")).alias("revision"))


def citation_keys(rows: DataFrame, base: Column, taken: DataFrame, pos: str = "pos") -> DataFrame:
    """rows with key: the base, then base with a to z, then base_1, base_2, ...; keys already taken count as used up.

    taken: (key, base). Numbers of one base are dealt in order of pos.
    """
    used = taken.groupBy("base").agg(F.count("*").alias("_used"))
    n = F.row_number().over(Window.partitionBy("base").orderBy(pos)) - 1 + F.coalesce("_used", F.lit(0))
    out = rows.withColumn("base", base).join(used, "base", "left").withColumn("_n", n)
    suffix = F.when(F.col("_n") == 0, "").when(F.col("_n") <= 26, F.chr(F.col("_n") + 96)).otherwise(F.concat(F.lit("_"), (F.col("_n") - 26).cast("string")))
    return out.withColumn("key", F.concat("base", suffix)).drop("_used", "_n")


def scrub_references(rows: DataFrame, ids: str, valid: DataFrame, tracked: str | None = None, cap: int | None = None) -> DataFrame:
    """rows whose id array holds only valid ids, each once in order, filled up to `cap` from the valid tracked ids.

    Columns n_ghosts and changed tell what went. Rows without ghosts are not filled up.
    """
    numbered = rows.withColumn("_r", F.xxhash64(*[F.to_json(F.struct("*"))]))
    every = F.col(ids) if tracked is None else F.concat(F.col(ids), F.coalesce(F.col(tracked), F.array().cast("array<string>")))
    there = numbered.select("_r", F.explode(F.array_distinct(every)).alias("id")).join(valid.select("id").distinct(), "id", "left_semi").groupBy("_r").agg(F.collect_set("id").alias("_ok"))
    both = numbered.join(there, "_r", "left").withColumn("_ok", F.coalesce("_ok", F.array().cast("array<string>")))
    old, ok = F.col(ids), F.col("_ok")
    kept = F.array_distinct(F.filter(old, lambda x: F.array_contains(ok, x)))
    ghosts = F.size(F.array_distinct(F.filter(old, lambda x: ~F.array_contains(ok, x))))
    fresh = kept
    if tracked is not None:
        more = F.array_distinct(F.concat(kept, F.filter(F.coalesce(F.col(tracked), F.array().cast("array<string>")), lambda x: F.array_contains(ok, x))))
        fresh = F.when(F.size(kept) >= cap, kept).otherwise(F.slice(more, 1, cap)) if cap else more
        fresh = F.when(ghosts > 0, fresh).otherwise(kept)
    return both.withColumns({"n_ghosts": ghosts, "_new": fresh}).withColumn("changed", F.col("_new") != old).withColumn(ids, F.col("_new")).drop("_r", "_ok", "_new")


def retention_plan(items: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """items with reasons to keep (protected, retention, current, referenced, pinned) and collectable: none of them."""
    young = F.col("created_at") > now - F.make_dt_interval(F.lit(days))
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in (("protected", F.col("protected")), ("retention", young), ("current", F.col("current")), ("referenced", F.col("referenced")), ("pinned", F.col("pinned")))]))
    return items.withColumn("reasons", reasons).withColumn("collectable", F.size("reasons") == 0)


def capacity_plan(used: Column, reserved: Column, estimate: Column, cap: Column) -> Column:
    """struct<projected, admitted, alert>: admitted up to the cap, alert from four fifths of it."""
    total = F.coalesce(used, F.lit(0)) + F.coalesce(reserved, F.lit(0)) + F.coalesce(estimate, F.lit(0))
    return F.struct(total.alias("projected"), (total <= cap).alias("admitted"), (total >= 0.8 * cap).alias("alert"))


def latest(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each group by several columns, all columns kept; map-side combined, without a sort."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*by, "_r.*")


def rotated(rows: DataFrame, key: str, cursor: str, n: int, cohort: str | None = None, per_cohort: int | None = None) -> DataFrame:
    """A sweep's next n rows: keys above the cursor in order, then from the start; at most per_cohort of each cohort."""
    order = [F.col(key) <= cursor, F.col(key)]
    if cohort and per_cohort:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(cohort).orderBy(*order))).where(F.col("_n") <= per_cohort).drop("_n")
    return rows.orderBy(*order).limit(n)


def prefix_closure(receipts: DataFrame) -> DataFrame:
    """Receipts whose ancestor chain is no extension of their parent's by one: (receipt_id, reason)."""
    parents = receipts.select(F.col("receipt_id").alias("_p"), F.col("ancestors").alias("_chain"))
    both = receipts.join(parents, F.try_element_at("ancestors", F.lit(-1)) == F.col("_p"), "left")
    n = F.size("ancestors")
    prefix = F.slice("ancestors", F.lit(1), F.greatest(n - 1, F.lit(0)))
    reason = F.when(n == 0, F.lit(None)).when(F.col("_p").isNull(), "missing_parent").when(prefix != F.col("_chain"), "broken_prefix")
    return both.select("receipt_id", reason.alias("reason")).where("reason IS NOT NULL")
