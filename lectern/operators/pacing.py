"""Admission of calls by windows, concurrency and cooldowns, and a breaker with probation, decided event by event.

What an event finds depends on those before it, but not on all: there are moments at which the state is certain to be
fresh, whatever came before. Logs are cut there, by aggregates over spans of time, so that a busy key's log spreads over
tasks; what lies between two cuts is folded in order with a state of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EVENTS = ("send", "response", "result", "cool")
TOO_MANY = 429


class Policy(NamedTuple):
    """Requests allowed per window of seconds, calls in flight, and what starts a cooldown of `quiet` seconds: `cluster` timeouts within `cluster_seconds`, or an answer 429."""

    windows: tuple[tuple[int, float], ...]
    concurrency: int = 1
    quiet: float = 60.0
    cluster: int = 3
    cluster_seconds: float = 60.0

    @property
    def memory(self) -> float:
        """Seconds after which nothing but calls in flight is remembered."""
        return max(self.quiet, self.cluster_seconds, *(s for _, s in self.windows))


class Pace:
    """State of one key: times sent, tickets in flight, times of timeouts, end of the cooldown (None: not cooling)."""

    def __init__(self, sends=(), active=(), timeouts=(), until=None):
        self.sends, self.active, self.timeouts, self.until = list(sends), list(active), list(timeouts), until

    def step(self, p: Policy, at: float, kind: str, ticket: str | None, status: int | None, timed_out: bool) -> tuple[str, float]:
        """(outcome, seconds to wait) of one event; an event that is no send gets ok, or unknown if its ticket is not in flight."""
        if kind in ("response", "result") and ticket not in self.active:
            return "unknown", 0.0
        if kind != "response":
            longest = max(s for _, s in p.windows)
            self.sends = [x for x in self.sends if x > at - longest]
            self.timeouts = [x for x in self.timeouts if x > at - p.cluster_seconds]
            if self.until is not None and at >= self.until:
                self.until, self.timeouts = None, []
        if kind == "send":
            if self.until is not None:
                return "cooldown", self.until - at
            if len(self.active) >= p.concurrency:
                return "concurrency", 0.0
            inside = [(n, s, [x for x in self.sends if x > at - s]) for n, s in p.windows]
            waits = [held[-n] + s - at for n, s, held in inside if len(held) >= n]
            if waits:
                return "window", max(waits)
            self.sends.append(at)
            self.active.append(ticket)
            return "sent", 0.0
        if kind == "result":
            self.active.remove(ticket)
            if timed_out and status != TOO_MANY:
                self.timeouts.append(at)
        cools = status == TOO_MANY if kind != "cool" else self.until is None
        if cools or kind == "result" and timed_out and (self.until is not None or len(self.timeouts) >= p.cluster):
            self.until = at + p.quiet
        return "ok", 0.0


_ROW = "seq long, at double, kind string, ticket string, status int, timed_out boolean"
_OUT = "seq long, outcome string, wait double, in_flight int, cooling_until double"


def _log(events: DataFrame, by: str) -> DataFrame:
    known = events.where(F.col(by).isNotNull() & F.col("at").isNotNull() & F.col("seq").isNotNull() & F.col("kind").isin(*EVENTS))
    return known.select(by, F.col("seq").cast("long").alias("seq"), F.col("at").cast("double").alias("at"), "kind", F.col("ticket").cast("string").alias("ticket"), F.col("status").cast("int").alias("status"), F.coalesce("timed_out", F.lit(False)).alias("timed_out"))


def _steps(state: Pace, policy: Policy, rows: pd.DataFrame) -> list[tuple]:
    out = []
    for seq, at, kind, ticket, status, late in zip(*[rows[c] for c in ("seq", "at", "kind", "ticket", "status", "timed_out")], strict=True):
        outcome, wait = state.step(policy, float(at), kind, ticket, None if pd.isna(status) else int(status), bool(late))
        out.append((seq, outcome, wait, len(state.active), state.until))
    return out


def _folded(rows: DataFrame, by: str, order: list[str], out: str, start, steps) -> DataFrame:
    """Rows of each (by, island) folded in order, batch by batch: a task holds a batch and one state."""
    kind = rows.schema[by].dataType.simpleString()
    names = [by, *[x.split()[0] for x in out.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            told = []
            begins = (batch[by].ne(batch[by].shift()) | batch["island"].ne(batch["island"].shift())).cumsum()
            for _, part in batch.groupby(begins, sort=False):
                here = (part[by].iloc[0], part["island"].iloc[0])
                if here != last:
                    last, state = here, start()
                told += [(here[0], *r) for r in steps(state, part)]
            yield pd.DataFrame(told, columns=names)

    return rows.repartition(by, "island").sortWithinPartitions(by, "island", *order).mapInPandas(run, f"`{by}` {kind}, {out}")


def paced(events: DataFrame, policy: Policy, by: str = "scope") -> DataFrame:
    """(by, seq, outcome, wait, in_flight, cooling_until): what each event meets and what it leaves.

    events: (by, seq, at in seconds, kind, ticket, status, timed_out), in order of at and seq. A send is sent, or refused for
    a cooldown, concurrency or a window, with the seconds to wait; only what was sent counts. A response with status
    429 cools at once, so does a result; a timeout cools if it is one of a cluster or falls in a cooldown; an event `cool`
    starts one unless one runs. Rows without key, time, number or a kind of EVENTS are passed over; a ticket that two
    sends bear raises ValueError.

    A log is cut where `policy.memory` seconds are still and every earlier send has its result. As such a gap ends in
    another span of that length than it began in, spans of time are summed up and only they are put in order.
    """
    log = _log(events, by)
    first, gap = F.struct("at", "seq"), policy.memory
    tickets = log.where(F.col("kind").isin("send", "result")).groupBy(by, "ticket").agg(F.count_if(F.col("kind") == "send").alias("n"), F.min(F.when(F.col("kind") == "send", first)).alias("s"), F.min(F.when(F.col("kind") == "result", first)).alias("r")).where("n > 0")
    twice = tickets.where("n > 1").select("ticket").first()
    if twice:
        raise ValueError(f"two sends of one ticket: {twice['ticket']}")

    def span(at: str):
        return F.floor(F.col(at) / gap).alias("span")

    opened = tickets.select(by, span("s.at"), F.lit(1).alias("d"))
    closed = tickets.where("r > s").select(by, span("r.at"), F.lit(-1).alias("d"))
    open_by_span = opened.union(closed).groupBy(by, "span").agg(F.sum("d").alias("d"))
    spans = log.groupBy(by, span("at")).agg(F.min("at").alias("lo"), F.max("at").alias("hi")).join(open_by_span, [by, "span"], "left")
    w = Window.partitionBy(by).orderBy("span")
    upto = F.coalesce(F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = (F.col("lo") - F.lag("hi").over(w) >= gap) & (upto == 0)
    spans = spans.withColumn("_cut", F.when(cut, 1).otherwise(0)).select(by, "span", F.sum("_cut").over(w).alias("island"))
    rows = log.withColumn("span", span("at")).join(spans, [by, "span"]).drop("span")
    return _folded(rows, by, ["at", "seq"], _OUT, Pace, lambda state, part: _steps(state, policy, part))


class _Pacer(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then takes them in order."""

    def __init__(self, policy: Policy, by: str):
        self.policy, self.by = policy, by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.pace = handle.getValueState("pace", "sends array<double>, active array<string>, timeouts array<double>, until double")

    @staticmethod
    def kept(rows: pd.DataFrame) -> list[tuple]:
        """Rows as state takes them: a number of another type than the schema's would come back as null."""
        columns = [rows[c] for c in ("seq", "at", "kind", "ticket", "status", "timed_out")]
        return [(int(n), float(at), kind, ticket, None if pd.isna(status) else int(status), bool(late)) for n, at, kind, ticket, status, late in zip(*columns, strict=True)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for new in rows:
            self.waiting.appendList(self.kept(new))
            self.handle.registerTimer(int(new["at"].min() * 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _ROW.split(", ")]
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        held = pd.DataFrame([tuple(r) for r in self.waiting.get()], columns=names)
        ready, later = held[held["at"] <= passed].sort_values(["at", "seq"]), held[held["at"] > passed]
        if ready.empty:
            return iter([])
        state = Pace(*self.pace.get()) if self.pace.exists() else Pace()
        told = [(key[0], *r) for r in _steps(state, self.policy, ready)]
        self.pace.update((state.sends, state.active, state.timeouts, None if state.until is None else float(state.until)))
        if later.empty:
            self.waiting.clear()
        else:
            self.waiting.put(self.kept(later))
            self.handle.registerTimer(int(later["at"].min() * 1000))
        return iter([pd.DataFrame(told, columns=[self.by, *[x.split()[0] for x in _OUT.split(", ")]])])

    def close(self) -> None:
        pass


def paced_streamed(events: DataFrame, policy: Policy, by: str = "scope", late: str = "1 hour") -> DataFrame:
    """paced() on a stream; rows later than `late` are dropped, all others count in order of time, whenever they come.

    Rows wait in state until the watermark passes them, which a timer tells, and are decided then; so the state of a key is
    what came within `late`, and its pace. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    kind = events.schema[by].dataType.simpleString()
    log = _log(events, by).withColumn("_time", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).withWatermark("_time", late)
    return log.groupBy(by).transformWithStateInPandas(_Pacer(policy, by), f"`{by}` {kind}, {_OUT}", "append", "eventtime")


class Circuit:
    """State of a breaker: degraded outcomes in a row, and until when it is open (None: closed)."""

    def __init__(self):
        self.fails, self.until = 0, None


def _calls(state: Circuit, rows: pd.DataFrame, trips: int, cooldown: float) -> list[tuple]:
    out = []
    for seq, at, degraded in zip(rows["seq"], rows["at"], rows["degraded"], strict=True):
        if state.until is not None and at < state.until:
            out.append((seq, "skipped", state.fails, state.until))
            continue
        phase = "called" if state.until is None else "probed"
        if not degraded:
            state.fails, state.until = 0, None
        else:
            state.fails += 1
            if state.until is not None or state.fails >= trips:
                state.until = at + cooldown
        out.append((seq, phase, state.fails, state.until))
    return out


def probation_breaker(calls: DataFrame, by: str = "backend", trips: int = 3, cooldown: float = 3600.0) -> DataFrame:
    """(by, seq, decision, fails, open_until): each call is called, skipped while the circuit is open, or probed after the cooldown.

    calls: (by, seq, at in seconds, degraded: how it ends if it is made), in order of at and seq. `trips` degraded calls in a row
    open the circuit for `cooldown` seconds; then it is on probation: a degraded probe opens it anew, only a success closes it and
    forgets. trips below 1: never open, degraded calls are not counted. Rows without key, time or number are passed over; a null
    outcome counts as degraded.

    A success is surely made if no call degraded within `cooldown` before it, and leaves a fresh state: the log is cut behind it.
    """
    log = calls.where(F.col(by).isNotNull() & F.col("at").isNotNull() & F.col("seq").isNotNull()).select(by, F.col("seq").cast("long").alias("seq"), F.col("at").cast("double").alias("at"), F.coalesce("degraded", F.lit(True)).alias("degraded"))
    if trips < 1:
        return log.select(by, "seq", F.lit("called").alias("decision"), F.lit(0).alias("fails"), F.lit(None).cast("double").alias("open_until"))
    rows = log.withColumn("span", F.floor(F.col("at") / cooldown))
    inside = Window.partitionBy(by, "span").orderBy("at", "seq")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(by, "span").agg(F.max(F.when(F.col("degraded"), F.col("at"))).alias("_bad"))
    w = Window.partitionBy(by).orderBy("span")
    earlier = spans.select(by, "span", F.last("_bad", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    rows = rows.join(earlier, [by, "span"])
    bad = F.coalesce(F.max(F.when(F.col("degraded"), F.col("at"))).over(before), "_earlier")
    fresh = ~F.col("degraded") & (bad.isNull() | (bad + cooldown <= F.col("at")))
    rows = rows.withColumn("_fresh", F.when(fresh, 1).otherwise(0))
    # islands are numbered inside a span, behind those of the spans before
    ends = rows.groupBy(by, "span").agg(F.sum("_fresh").alias("n"))
    done = ends.select(by, "span", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_done"))
    rows = rows.join(done, [by, "span"]).withColumn("island", F.col("_done") + F.coalesce(F.sum("_fresh").over(before), F.lit(0)))
    return _folded(rows.select(by, "seq", "at", "degraded", "island"), by, ["at", "seq"], "seq long, decision string, fails int, open_until double", Circuit, lambda state, part: _calls(state, part, trips, cooldown))
