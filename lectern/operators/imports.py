"""Imports of a legacy ledger: a snapshot and the changes after it, every event judged in the state right after its change.

How many rows named a unit or a document at that moment is a running sum of arrivals and departures, by unit and by
document; no window goes over all changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def checked_changes(snapshot: DataFrame, changes: DataFrame, start: int, end: int | None = None) -> None:
    """Raise ValueError unless changes follow the snapshot's sequence without a gap, up to `end` if given, and every old image is the one before.

    snapshot: (row_id, image); changes: (sequence, operation, old_id, old_image, new_id, new_image). An INSERT must find no
    row under its id and bring a new image, an UPDATE or DELETE must bring the old one, an UPDATE also a new one.
    """
    c = changes.withColumn("sequence", F.col("sequence").cast("long"))
    seen = c.agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("d"), F.min("sequence").alias("lo"), F.max("sequence").alias("hi")).first()
    last = start + seen["n"]
    if seen["n"] and (seen["d"] != seen["n"] or seen["lo"] != start + 1 or seen["hi"] != last) or end is not None and last != end:
        raise ValueError("changes must follow the snapshot's sequence without a gap")
    op, old, new = F.col("operation"), F.col("old_id").isNotNull(), F.col("new_id").isNotNull()
    odd = F.when(~op.isin("INSERT", "UPDATE", "DELETE"), "unknown operation").when((op != "INSERT") & ~old, "no old row").when((op != "DELETE") & ~new, "no new row")
    # what happens to an id: it leaves with its old image, it comes with its new one; at one sequence it leaves first
    leaves = c.where((op != "INSERT") & old).select(F.col("old_id").alias("row_id"), "sequence", F.lit(0).alias("k"), F.col("old_image").alias("image"))
    comes = c.where((op != "DELETE") & new).select(F.col("new_id").alias("row_id"), "sequence", F.lit(1).alias("k"), F.col("new_image").alias("image"), (op == "INSERT").alias("fresh"))
    first = snapshot.select("row_id", F.lit(start).cast("long").alias("sequence"), F.lit(1).alias("k"), "image", F.lit(False).alias("fresh"))
    w = Window.partitionBy("row_id").orderBy("sequence", "k")
    steps = comes.unionByName(leaves, allowMissingColumns=True).unionByName(first).select("*", F.lag("image").over(w).alias("_image"), F.lag("k").over(w).alias("_k"))
    there = _yes(F.col("_k") == 1)
    wrong = F.when((F.col("k") == 0) & ~(there & F.col("_image").eqNullSafe(F.col("image"))), "old image disagrees").when(_yes(F.col("fresh")) & there, "insert already exists")
    bad = c.select("sequence", odd.alias("problem")).union(steps.select("sequence", wrong.alias("problem"))).where("problem IS NOT NULL").agg(F.min(F.struct("sequence", "problem")).alias("p")).first()["p"]
    if bad:
        raise ValueError(f"change {bad['sequence']}: {bad['problem']}")


def import_events(snapshot: DataFrame, changes: DataFrame, mappings: DataFrame, statuses: DataFrame, start: int = 0) -> DataFrame:
    """(row_id, sequence, operation, deleted, doc, unit_id, failures, dispositions): the snapshot's rows, and for each change the rows it removes or brings.

    snapshot: (row_id, doc, failures); changes: (sequence, operation, old struct, new struct of the same fields, null where
    there is none); mappings: (row_id, unit_id), given and never guessed; statuses: (doc). A change of identity removes the old
    row and brings the new. A row with one mapping has its unit. Dispositions stand in order: matched or ledger_only (a
    status names the document), conflicting_mapping or unmatched_unit (several or no mappings), duplicate_unit and
    duplicate_document_identity (another row stands for the unit or document at that moment), duplicate_docstatus,
    provenance_gap, source_deleted, invalid_failure_counter (null or negative).
    """
    fields = ("row_id", "doc", "failures")

    def part(side: str) -> list[Column]:
        return [F.col(f"{side}.{f}").alias(f) for f in fields]

    log = changes.withColumn("sequence", F.col("sequence").cast("long"))
    olds = log.where("operation <> 'INSERT' AND old IS NOT NULL")
    news = log.where("operation <> 'DELETE' AND new IS NOT NULL")
    gone = olds.select("sequence", F.lit("DELETE").alias("operation"), *part("old"), F.lit(-1).alias("delta"), (_yes(F.col("operation") == "DELETE") | ~_yes(F.col("old.row_id") == F.col("new.row_id"))).alias("told"))
    came = news.select("sequence", "operation", *part("new"), F.lit(1).alias("delta"), F.lit(True).alias("told"))
    base = snapshot.select(F.lit(start).cast("long").alias("sequence"), F.lit("SNAPSHOT").alias("operation"), *fields, F.lit(1).alias("delta"), F.lit(True).alias("told"))
    steps = base.unionByName(gone).unionByName(came)

    def population(by: str) -> Column:
        """Rows of the same `by` after all that happens at this sequence."""
        return F.sum("delta").over(Window.partitionBy(by).orderBy("sequence").rangeBetween(Window.unboundedPreceding, Window.currentRow))

    steps = steps.withColumn("_docs", population("doc"))
    known = mappings.groupBy("row_id").agg(F.count("*").alias("_n"), F.collect_set("unit_id").alias("_units"))  # a row's mappings are few
    mapped = steps.join(known, "row_id", "left").withColumn("unit_id", F.when(F.col("_n") == 1, F.get("_units", F.lit(0))))
    # a unit's population counts every row mapped to it, also among others
    other = mapped.select("sequence", "delta", F.explode("_units").alias("of"))
    moved = other.groupBy("of", "sequence").agg(F.sum("delta").alias("delta"))
    units = moved.select("of", F.col("sequence").alias("s"), population("of").alias("_rows"))
    named = statuses.groupBy("doc").agg(F.count("*").alias("_said"))
    rows = mapped.where("told").join(units, (F.col("unit_id") == F.col("of")) & (F.col("sequence") == F.col("s")), "left").join(named, "doc", "left")
    deleted = F.col("delta") < 0
    tests = [
        (F.col("_said").isNotNull(), "matched"), (F.col("_said").isNull(), "ledger_only"), (F.col("_n") > 1, "conflicting_mapping"), (F.col("_n").isNull(), "unmatched_unit"),
        (F.col("_rows") > 1, "duplicate_unit"), (F.col("_docs") > 1, "duplicate_document_identity"), (F.col("_said") > 1, "duplicate_docstatus"), (F.lit(True), "provenance_gap"),
        (deleted, "source_deleted"), (F.col("failures").isNull() | (F.col("failures") < 0), "invalid_failure_counter"),
    ]
    said = F.array_compact(F.array(*[F.when(_yes(bad), name) for bad, name in tests]))
    return rows.select("row_id", "sequence", "operation", deleted.alias("deleted"), "doc", "unit_id", "failures", said.alias("dispositions"))


def import_sets(events: DataFrame, statuses: DataFrame) -> DataFrame:
    """(name, row_id, doc, sequence): the sets that each row's last event is in, which overlap, and documents that only a status names.

    matches or ledger_only, provenance_gaps, duplicates (any duplicate_ disposition) and conflicts (several mappings or a bad
    counter); docstatus_only once for each status row of a document that no live row has, and duplicates once more for such a
    document with several. events: import_events().
    """
    last = events.groupBy("row_id").agg(F.max_by(F.struct("sequence", "deleted", "doc", "dispositions"), "sequence").alias("e")).select("row_id", "e.*")

    def has(name: str) -> Column:
        return F.array_contains("dispositions", name)

    sets = {
        "matches": has("matched"), "ledger_only": has("ledger_only"), "provenance_gaps": has("provenance_gap"),
        "duplicates": F.exists("dispositions", lambda x: x.startswith("duplicate")), "conflicts": has("conflicting_mapping") | has("invalid_failure_counter"),
    }
    rows = last.select(F.explode(F.array_compact(F.array(*[F.when(x, n) for n, x in sets.items()]))).alias("name"), "row_id", "doc", "sequence")
    alone = statuses.select("doc").join(last.where("NOT deleted").select("doc"), "doc", "left_anti")
    several = alone.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1")
    only = alone.select(F.lit("docstatus_only").alias("name"), "doc").union(several.select(F.lit("duplicates"), "doc"))
    return rows.unionByName(only, allowMissingColumns=True)
