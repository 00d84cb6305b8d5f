"""Commands on units, reduced to the state of each unit's job: an automaton that also knows whose attempt is the current one.

A command acts once, under its operation id. What a run of commands does to a unit is a function of the state before it:
the automaton's state, and the token of the current attempt, of which only those that the run names matter. So a unit
with many commands is split: every run of some hundred commands gives its function as a table, by running it from all
states side by side; the tables are applied one after the other; then each run is replayed from the state it starts in.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.lineage import saved

# The names of phases and actions, and the failures in a row that park a unit.
PHASES = ("absent", "queued", "running", "retiring", "sealed", "succeeded", "publishing", "published", "failed", "cancelled")
PARKED = 3
#: action: the phases in which it is lawful, each with the phase after it.
MOVES = {
    "enqueue": {"absent": "queued"} | {p: p for p in PHASES[1:]},
    "claim": {"queued": "running", "failed": "running"},
    "rebase": {"queued": "running", "failed": "running", "succeeded": "running", "published": "running"},
    "renew": {p: p for p in ("running", "retiring", "sealed")},
    "accept_submission": {p: p for p in ("running", "retiring")},
    "record_tombstone": {p: p for p in ("running", "retiring")},
    "begin_retirement": {"running": "retiring"},
    "seal_namespace": {p: "sealed" for p in ("running", "retiring", "sealed")},
    "complete": {"sealed": "succeeded", "succeeded": "succeeded", "publishing": "publishing"},
    "defer_attempt": {p: "queued" for p in ("running", "retiring")},
    "fail": {p: "failed" for p in ("running", "retiring", "sealed")},
    "fail_retirement": {p: "failed" for p in ("running", "retiring")},
    "expire_attempt": {p: "failed" for p in ("running", "retiring", "sealed")},
    "cancel": {p: "cancelled" for p in ("running", "retiring", "sealed")},
    "claim_publication": {"succeeded": "publishing"},
    "publish_derivation": {"publishing": "published"},
    "reset_reducer": {p: p for p in PHASES if p not in ("absent", "running", "retiring", "sealed")},
    "quarantine": {p: p for p in PHASES},
    "clear_quarantine": {p: p for p in PHASES},
}
CLAIMS = ("claim", "rebase")
#: Actions that need the token of the current attempt.
OWNED = ("renew", "accept_submission", "record_tombstone", "begin_retirement", "seal_namespace", "complete", "defer_attempt", "fail", "fail_retirement", "expire_attempt", "cancel", "publish_derivation")
FAILURES, NEED_CLEAR = ("fail", "fail_retirement", "expire_attempt"), (*CLAIMS, "claim_publication", "publish_derivation")

ACTIONS = tuple(MOVES)
STREAKS = PARKED + 1
STATES = len(PHASES) * STREAKS * 2


def _table() -> np.ndarray:
    """The state after each action in each state, -1 where it is refused. A state is (phase, failures in a row, quarantined)."""
    out = np.full((len(ACTIONS), STATES), -1, np.int64)
    for a, action in enumerate(ACTIONS):
        for before, after in MOVES[action].items():
            for streak in range(STREAKS):
                for held in range(2):
                    if held and action in NEED_CLEAR or action in CLAIMS and streak >= PARKED:
                        continue
                    now = min(streak + 1, PARKED) if action in FAILURES else 0 if action == "reset_reducer" or after == "succeeded" and before == "sealed" else streak
                    then = 1 if action == "quarantine" else 0 if action == "clear_quarantine" else held
                    out[a, code(before, streak, held)] = code(after, now, then)
    return out


def code(phase: str, streak: int, held: int) -> int:
    return (PHASES.index(phase) * STREAKS + streak) * 2 + held


_NEXT = _table()
_CLAIM = np.array([a in CLAIMS for a in ACTIONS])
_OWN = np.array([a in OWNED for a in ACTIONS])
START = code("absent", 0, 0)
NOBODY = -1


def replay(actions: np.ndarray, tokens: np.ndarray, state: int, token: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each command is accepted, and the state and token after it. Unknown actions are refused."""
    ok, states, holders = np.zeros(len(actions), bool), np.empty(len(actions), np.int64), np.empty(len(actions), np.int64)
    for i, (a, t) in enumerate(zip(actions.tolist(), tokens.tolist(), strict=True)):
        if a >= 0 and (then := int(_NEXT[a, state])) >= 0 and (not _OWN[a] or t == token):
            ok[i], state = True, then
            token = t if _CLAIM[a] else token
        states[i], holders[i] = state, token
    return ok, states, holders


def summed(actions: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The function of a run: its tokens, and for each of them (and last for any other) by each state the state and the token's place after it."""
    own = np.unique(tokens)
    places = np.searchsorted(own, tokens)
    state = np.tile(np.arange(STATES), len(own) + 1)
    holder = np.repeat(np.arange(len(own) + 1), STATES)
    for a, t in zip(actions.tolist(), places.tolist(), strict=True):
        if a < 0:
            continue
        then = _NEXT[a][state]
        ok = then >= 0
        if _OWN[a]:
            ok &= holder == t
        state = np.where(ok, then, state)
        if _CLAIM[a]:
            holder = np.where(ok, t, holder)
    return own, state, holder


def follow(table: tuple[np.ndarray, np.ndarray, np.ndarray], state: int, token: int) -> tuple[int, int]:
    own, states, holders = (np.asarray(x) for x in table)
    at = int(np.searchsorted(own, token))
    if at == len(own) or own[at] != token:
        at = len(own)
    then = int(holders[at * STATES + state])
    return int(states[at * STATES + state]), token if then == len(own) else int(own[then])


def first_operations(log: DataFrame) -> DataFrame:
    """(operation_id, unit, seq, action, token): each operation as first seen; one that comes again with other content raises.

    log: (operation_id, unit, seq, action, token, payload).
    """
    content = F.sha2(F.to_json(F.struct("unit", "action", "token", "payload"), {"ignoreNullFields": "false"}), 256)
    once = log.groupBy("operation_id").agg(F.min_by(F.struct("unit", "seq", "action", "token"), "seq").alias("c"), F.min(content).alias("_a"), F.max(content).alias("_b"))
    same = F.when(F.col("_a") == F.col("_b"), F.col("c")).otherwise(F.raise_error(F.concat(F.lit("operation comes again with other content: "), F.col("operation_id").cast("string"))).cast(once.schema["c"].dataType))
    return once.select("operation_id", same.alias("c")).select("operation_id", "c.*")


def _numbered(rows: DataFrame) -> DataFrame:
    """Commands with `a`, the number of the action (-1 if unknown), and `t`, the token or -1."""
    place = F.array_position(F.array(*map(F.lit, ACTIONS)), F.coalesce("action", F.lit(""))).cast("int") - 1
    return rows.withColumns({"a": place, "t": F.coalesce(F.col("token").cast("long"), F.lit(NOBODY))})


_TOLD = "accepted boolean, phase string, failures int, quarantined boolean, holder long"


def _told(ok: np.ndarray, states: np.ndarray, holders: np.ndarray) -> dict:
    return {"accepted": ok, "phase": np.array(PHASES, object)[states // (2 * STREAKS)], "failures": (states // 2 % STREAKS).astype(np.int32), "quarantined": states % 2 == 1, "holder": pd.Series(holders, dtype="Int64").mask(holders == NOBODY)}


def commands_reduced(log: DataFrame, run: int = 512) -> DataFrame:
    """(operation_id, unit, seq, accepted, phase, failures, quarantined, holder): what became of each operation, and its unit's state after it.

    log: (operation_id, unit, seq, action, token, payload), seq distinct and in order of the commands, token a whole number
    of 0 or more. Operations act once (first_operations()). A unit begins absent. Units with more than `run` commands are
    split at cells of 64 numbers into runs of about that many, so no task holds more of a unit than a run, and tables of all its runs.
    """
    ops = saved(_numbered(first_operations(log)).drop("action", "token"), "operations")
    kinds = {f.name: f.dataType.simpleString() for f in ops.schema.fields}
    large = ops.groupBy("unit").agg(F.count("*").alias("_n")).where(F.col("_n") > run).select("unit")
    cells = ops.join(large, "unit", "left_semi").groupBy("unit", F.floor(F.col("seq") / 64).alias("cell")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("unit").orderBy("cell")) - F.col("_n")
    cells = cells.select("unit", "cell", F.floor(before / run).alias("run"))
    dealt = saved(ops.withColumn("cell", F.floor(F.col("seq") / 64)).join(cells, ["unit", "cell"], "left").drop("cell"), "runs")  # run is null where a unit is whole

    def table(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        own, states, holders = summed(group["a"].to_numpy(), group["t"].to_numpy())
        return pd.DataFrame({"unit": [group["unit"].iloc[0]], "run": [group["run"].iloc[0]], "own": [own], "states": [states.astype(np.int16)], "holders": [holders.astype(np.int32)]})

    tables = dealt.where("run IS NOT NULL").groupBy("unit", "run").applyInPandas(table, f"unit {kinds['unit']}, run long, own array<long>, states array<short>, holders array<int>")

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, state, token = None, START, NOBODY
        for batch in batches:
            begins = []
            for u, k, *function in batch.itertuples(index=False):
                if u != unit:
                    unit, state, token = u, START, NOBODY
                begins.append((u, k, state, token))
                state, token = follow(tuple(function), state, token)
            yield pd.DataFrame(begins, columns=["unit", "run", "state", "held"])

    starts = tables.repartition("unit").sortWithinPartitions("unit", "run").mapInPandas(chained, f"unit {kinds['unit']}, run long, state int, held long")
    full = dealt.where("run IS NULL").withColumns({"state": F.lit(START), "held": F.lit(NOBODY).cast("long")}).unionByName(dealt.where("run IS NOT NULL").join(starts, ["unit", "run"]))

    def played(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, state, token = None, START, NOBODY
        for batch in batches:
            ids, begins, held = (batch[c].to_numpy() for c in ("_group", "state", "held"))
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)] if len(ids) else [0]
            parts = []
            for lo, hi in pairwise(cuts):
                if ids[lo] != group:  # else a batch has cut the group
                    group, state, token = ids[lo], int(begins[lo]), int(held[lo])
                parts.append(replay(batch["a"].to_numpy()[lo:hi], batch["t"].to_numpy()[lo:hi], state, token))
                state, token = int(parts[-1][1][-1]), int(parts[-1][2][-1])
            if parts:
                yield batch[["operation_id", "unit", "seq"]].assign(**_told(*map(np.concatenate, zip(*parts, strict=True))))

    kind = f"operation_id {kinds['operation_id']}, unit {kinds['unit']}, seq {kinds['seq']}, {_TOLD}"
    group = F.xxhash64(F.col("unit").isNull(), "unit", F.col("run").isNull(), "run")
    return full.withColumn("_group", group).repartition("_group").sortWithinPartitions("_group", "unit", "run", "seq").mapInPandas(played, kind)


def commands_streamed(log: DataFrame) -> DataFrame:
    """The same on a stream; commands of a unit inside a micro-batch are taken in order of seq, and a repeated operation gives no row.

    State per unit: the automaton's state, the current token and a digest of each operation taken, by which an operation that
    comes again with other content raises. It grows with the operations of a unit.
    """
    kinds = {f.name: f.dataType.simpleString() for f in log.schema.fields}
    content = F.sha2(F.to_json(F.struct("unit", "action", "token", "payload"), {"ignoreNullFields": "false"}), 256)
    rows = _numbered(log).select("unit", F.col("operation_id").cast("string").alias("operation_id"), "seq", "a", "t", content.alias("digest"))

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        q, token, ids, digests = state.get if state.exists else (START, NOBODY, [], [])
        known, fresh = dict(zip(ids, digests, strict=True)), []
        group = pd.concat(list(batches)).sort_values("seq")
        for i, (operation, digest) in enumerate(zip(group["operation_id"], group["digest"], strict=True)):
            if known.setdefault(operation, digest) != digest:
                raise ValueError(f"operation comes again with other content: {operation}")
            if len(known) > len(ids) + len(fresh):
                fresh.append(i)
        group = group.iloc[fresh]
        ok, states, holders = replay(group["a"].to_numpy(), group["t"].to_numpy(), q, token)
        if len(group):
            q, token = int(states[-1]), int(holders[-1])
        state.update((q, token, list(known), list(known.values())))
        yield pd.DataFrame({"operation_id": group["operation_id"].to_numpy(), "unit": name[0], "seq": group["seq"].to_numpy(), **_told(ok, states, holders)})

    return rows.groupBy("unit").applyInPandasWithState(step, f"operation_id string, unit {kinds['unit']}, seq {kinds['seq']}, {_TOLD}", "state int, held long, ids array<string>, digests array<string>", "append", GroupStateTimeout.NoTimeout)
