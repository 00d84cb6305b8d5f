"""State machines and event ledgers: per-key folds, sliding windows, breakers.

Where a window or a closed form gives a fold's result, it is used; otherwise a key's events go in
order through one pandas group, whose size is that of one key's history.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUCCESS = ("done", "done_meta", "done_abstract")


def attempt_machine(events: DataFrame, limit: int = 3, key: str = "key", order: str = "seq") -> DataFrame:
    """(key, seq, attempts, status) after every event (status, fingerprint) of a key.

    An error adds one and parks at `limit` (0: never); a success resets; so does a fingerprint that
    is new and not null; anything else keeps the count. As only errors add, the count is the errors
    since the last reset, which two windows give without a fold.
    """
    by = Window.partitionBy(key).orderBy(order)
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    error = F.col("status") == "error"
    known = F.last("fingerprint", ignorenulls=True).over(before)
    reset = ~error & (F.col("status").isin(*SUCCESS) | (F.col("fingerprint").isNotNull() & ~F.col("fingerprint").eqNullSafe(known)))
    runs = events.withColumn("_run", F.sum(F.when(reset, 1).otherwise(0)).over(upto))
    count = F.sum(F.when(error, 1).otherwise(0)).over(Window.partitionBy(key, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    parked = error & (F.lit(limit) > 0) & (F.col("attempts") >= limit)
    return runs.withColumn("attempts", count).select(key, order, F.col("attempts").cast("long").alias("attempts"), F.when(parked, "error_parked").otherwise(F.col("status")).alias("status"))


def failure_streaks(events: DataFrame, by: str, order: str, failed: Column, threshold: int) -> DataFrame:
    """Longest run of failures of each key, and whether the breaker would have opened: gaps and islands."""
    w = Window.partitionBy(by).orderBy(order)
    runs = events.withColumn("_f", failed).withColumn("_run", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    longest = runs.groupBy(by, "_run").agg(F.sum(F.when(F.col("_f"), 1).otherwise(0)).alias("n")).groupBy(by).agg(F.max("n").alias("longest"))
    return longest.select(by, "longest", (F.col("longest") >= threshold).alias("opened"))


def window_violations(sends: DataFrame, by: str, at: str, limit: int, seconds: float, tie: str) -> DataFrame:
    """Sends at which a window (at - seconds, at] holds more than `limit`; of equal times only those up to the send count.

    The left border is open: a RANGE frame over microseconds ends one short of it. Peers after a
    send in the order of `tie` are taken off the frame's count.
    """
    micros = F.unix_micros(at)
    span = int(seconds * 1_000_000)
    upto = Window.partitionBy(by).orderBy(micros).rangeBetween(-(span - 1), 0)
    peers = Window.partitionBy(by, at).orderBy(F.col(tie).desc())
    n = F.count("*").over(upto) - (F.row_number().over(peers) - 1)
    return sends.withColumn("in_window", n).where(F.col("in_window") > limit)


def retry_after(sends: DataFrame, by: str, at: str, windows: Sequence[tuple[int, float]], now: Column) -> DataFrame:
    """Seconds each key must wait until every window (requests, seconds) has room; 0 if all have."""
    most = max(n for n, _ in windows)
    recent = sends.select(by, F.col(at).alias("_at")).withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.col("_at").desc()))).where(F.col("_n") <= most)
    waits = [F.max(F.when(F.col("_n") == n, F.col("_at").cast("double") + s - now.cast("double"))) for n, s in windows]
    return recent.groupBy(by).agg(F.greatest(F.lit(0.0), *[F.coalesce(x, F.lit(0.0)) for x in waits]).alias("wait"))


def in_flight_duplicates(attempts: DataFrame, threshold: int = 1) -> DataFrame:
    """Identities with more than `threshold` distinct (key, lease) in flight."""
    return attempts.groupBy("identity").agg(F.count_distinct("key", "lease_id").alias("n")).where(F.col("n") > threshold)


def mismatches(rows: DataFrame, differs: Column, threshold: int = 0) -> DataFrame:
    """All differing rows if there are more than `threshold`, else none."""
    bad = rows.where(differs)
    n = bad.agg(F.count("*").alias("_n"))
    return bad.crossJoin(F.broadcast(n)).where(F.col("_n") > threshold).drop("_n")


def sliding_breaker(events: DataFrame, by: str, at: str, failed: str, threshold: int = 30, window: float = 300.0, cooldown: float = 600.0) -> DataFrame:
    """State of a breaker after each event: CLOSED, OPEN (calls refused until the cooldown ends) or HALF_OPEN.

    Failures of the last `window` seconds, the border included, open it; after the cooldown one call probes: a failure opens
    it anew, a success closes it and forgets. A key's events are folded in order.
    """
    kind = events.schema[by].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([at, "seq"])
        state, until, recent, out = "CLOSED", 0.0, [], []
        for t, bad in zip(group[at], group[failed], strict=True):
            if state == "OPEN" and t >= until:
                state = "HALF_OPEN"
            if state == "HALF_OPEN":
                state, until, recent = ("OPEN", t + cooldown, []) if bad else ("CLOSED", 0.0, [])
            elif state == "CLOSED" and bad:
                recent = [x for x in recent if x >= t - window] + [t]
                if len(recent) >= threshold:
                    state, until, recent = "OPEN", t + cooldown, []
            out.append(state)
        return pd.DataFrame({by: group[by], "seq": group["seq"], "state": out})

    return events.select(by, "seq", F.col(at).cast("double").alias(at), failed).groupBy(by).applyInPandas(run, f"`{by}` {kind}, seq long, state string")


def budget_fold(events: DataFrame, cap: float = 200.0) -> DataFrame:
    """(account, reserved, spent, starts, fenced, refused): ledger events folded per account in order of seq.

    reserve holds an amount if it fits the cap, refund frees it, dispatch counts a start, complete
    turns reserved into spent, fence closes the account, and merge resets it to the totals it records.
    """
    kind = events.schema["account"].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        reserved = spent = 0.0
        starts = refused = 0
        fenced = False
        for kind_, amount, total in group.sort_values("seq")[["kind", "amount", "total"]].itertuples(index=False):
            if kind_ == "merge":
                reserved, spent = 0.0, float(total)
            elif kind_ == "fence":
                fenced = True
            elif kind_ == "reserve":
                if fenced or reserved + spent + amount > cap:
                    refused += 1
                else:
                    reserved += amount
            elif kind_ == "refund":
                reserved = max(0.0, reserved - amount)
            elif kind_ == "dispatch":
                starts += 1
            elif kind_ == "complete":
                moved = min(reserved, amount)
                reserved, spent = reserved - moved, spent + moved
        return pd.DataFrame({"account": [group["account"].iloc[0]], "reserved": [reserved], "spent": [spent], "starts": [starts], "fenced": [fenced], "refused": [refused]})

    return events.groupBy("account").applyInPandas(run, f"account {kind}, reserved double, spent double, starts long, fenced boolean, refused long")


def claim_phase(events: DataFrame) -> DataFrame:
    """(key, state): the last legal transition of each claim in order of seq; a dispatched claim that expires is quarantined.

    queued, dispatched, completed, not_sent, released, quarantined. Events name the state they expect;
    an event whose expectation fails is passed over.
    """
    kind = events.schema["key"].dataType.simpleString()
    legal = {"dispatch": ("queued", "dispatched"), "complete": ("dispatched", "completed"), "not_sent": ("dispatched", "not_sent"), "release": ("queued", "released"), "expire": ("dispatched", "quarantined")}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        state = "queued"
        for what in group.sort_values("seq")["event"]:
            need, then = legal.get(what, (None, None))
            state = then if need == state else state
        return pd.DataFrame({"key": [group["key"].iloc[0]], "state": [state]})

    return events.groupBy("key").applyInPandas(run, f"key {kind}, state string")


def claim_valid(now: Column, epoch: Column, want_epoch: Column, fence: Column, want_fence: Column, lease_until: Column, starts: Column, ends: Column) -> Column:
    """A claim holds while epoch and fence are the current ones, its lease runs and its window is open."""
    return F.coalesce((epoch == want_epoch) & (fence == want_fence) & (lease_until > now) & (starts <= now) & (now < ends), F.lit(False))


def admission_wait(executing: Column, lanes: int, mean_service: Column) -> Column:
    """Seconds a new call would wait: calls ahead beyond the lanes times the mean service time."""
    return F.greatest(F.lit(0), executing + 1 - lanes) * mean_service


def rolling_mean(rows: DataFrame, by: Sequence[str], order: str, value: str, n: int = 20) -> DataFrame:
    return rows.withColumn("rolling_mean", F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0)))


def pause_until(now: Column, zone: str, windows: Sequence[tuple[str, str]], days: Sequence[int], holidays: Sequence[str] = ()) -> Column:
    """The end of the peak window that a moment is in, null outside: windows of local time on given weekdays (Monday 0), holidays apart.

    now: a timestamp; windows: ("HH:MM", "HH:MM"), the end excluded; the zone's own rules give the offset.
    """
    local = F.convert_timezone(F.current_timezone(), F.lit(zone), now.cast("timestamp_ntz"))
    day, clock = F.date_format(local, "yyyy-MM-dd"), F.date_format(local, "HH:mm:ss.SSSSSS")
    working = F.weekday(local).isin(*days)
    if holidays:
        working = working & ~day.isin(*holidays)
    end = F.lit(None).cast("timestamp")
    for start, stop in reversed(list(windows)):
        at = F.to_timestamp_ntz(F.concat(day, F.lit(f" {stop}:00")))
        back = F.convert_timezone(F.lit(zone), F.current_timezone(), at).cast("timestamp")
        end = F.when((clock >= f"{start}:00") & (clock < f"{stop}:00"), back).otherwise(end)
    return F.when(working, end)


def staged_conflicts(observed: DataFrame) -> DataFrame:
    """(conflict_id, key, fields, at): each distinct piece of evidence once, at its first sight.

    observed: (key, fields, existing, incoming, operation, at), all but `at` part of the evidence. Its digest is the id,
    so staging the same twice changes nothing.
    """
    digest = F.sha2(F.to_json(F.struct("key", "fields", "existing", "incoming", "operation")), 256)
    return observed.groupBy(digest.alias("conflict_id")).agg(F.min(F.struct("at", "key", "fields")).alias("f")).select("conflict_id", "f.key", "f.fields", "f.at")


def correction_batch(conflicts: DataFrame, papers: int, most: int) -> DataFrame:
    """(conflict_id, place): the next manifest, empty while fewer than `papers` distinct papers have a pending conflict.

    conflicts: (conflict_id, key, at, status). The papers whose pending conflicts are oldest come with one conflict each, then
    their other conflicts fill up to `most`, oldest first.
    """
    pending = conflicts.where("status = 'pending'")
    first = pending.groupBy("key").agg(F.min(F.struct("at", "conflict_id")).alias("f"))
    chosen = first.orderBy("f").limit(papers).withColumn("_p", F.row_number().over(Window.orderBy("f")))  # at most `papers` rows
    enough = chosen.agg((F.count("*") == papers).alias("_enough"))
    own = pending.join(F.broadcast(chosen), "key").withColumn("_lead", F.col("conflict_id") == F.col("f.conflict_id"))
    order = [(~F.col("_lead")), F.when(F.col("_lead"), F.col("_p")), F.col("at"), F.col("conflict_id")]
    cut = own.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)  # at most `most` rows
    return cut.crossJoin(F.broadcast(enough)).where("_enough").select("conflict_id", "place")


def adjudicated(manifest: DataFrame, answers: DataFrame) -> DataFrame:
    """(conflict_id, status, decision): answers to a manifest's conflicts; unanswered ones, and resolved ones without decision and evidence, need a human."""
    said = answers.groupBy("conflict_id").agg(F.min(F.struct("status", "decision", "evidence")).alias("a"), F.count("*").alias("_n"))
    both = manifest.select("conflict_id").join(said, "conflict_id", "left")
    sound = (F.col("_n") == 1) & (F.col("a.status") == "resolved") & (F.trim(F.coalesce("a.decision", F.lit(""))) != "") & (F.trim(F.coalesce("a.evidence", F.lit(""))) != "")
    return both.select("conflict_id", F.when(F.coalesce(sound, F.lit(False)), "resolved").otherwise("needs_human").alias("status"), F.coalesce("a.decision", F.lit("unadjudicated")).alias("decision"))
