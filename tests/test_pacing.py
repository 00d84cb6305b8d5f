"""Pacing and breakers against loops over whole logs; the stream against the batch."""

import random
import uuid

import pytest

from lectern.operators.pacing import Pace, Policy, paced, paced_streamed, probation_breaker

LOG = "scope string, seq long, at double, kind string, ticket string, status int, timed_out boolean"
POLICY = Policy(((3, 20.0), (6, 90.0)), concurrency=2, quiet=40.0, cluster=2, cluster_seconds=60.0)


def traffic(seed, n=900):
    r, out, seq = random.Random(seed), [], 0
    for scope, at in (("a", 0.0), ("b", 3.0), ("c", 0.0)):
        for k in range(n if scope == "a" else n // 6):
            at += r.choice([0.0, 1.0, 4.0, 9.0, 9.5, r.choice([30.0, 200.0])])
            ticket = f"{scope}{k}"
            out.append((scope, seq, at, "send", ticket, None, None))
            end = at + r.choice([0.0, 2.0, 15.0, 70.0])
            status, late = r.choice([(200, False), (200, None), (500, False), (None, True), (None, True), (429, False)])
            if status == 429 and r.random() < 0.5:
                out.append((scope, seq + 1, end, "response", ticket, 429, False))
            if r.random() < 0.999 or scope != "a":
                out.append((scope, seq + 2, end, "result", ticket, status, late))
            if r.random() < 0.02:
                out.append((scope, seq + 3, at, "cool", None, None, None))
            seq += 4
    r.shuffle(out)
    return out


def loop(rows):
    states, out = {}, []
    for scope, seq, at, kind, ticket, status, late in sorted(rows, key=lambda x: (x[2], x[1])):
        state = states.setdefault(scope, Pace())
        outcome, wait = state.step(POLICY, at, kind, ticket, status, bool(late))
        out.append((scope, seq, outcome, wait, len(state.active), state.until))
    return sorted(out)


def told(rows):
    return sorted(tuple(x) for x in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_cut_logs_give_what_whole_ones_give(spark, seed):
    rows = traffic(seed)
    got = told(paced(spark.createDataFrame(rows, LOG).repartition(3), POLICY).collect())
    assert got == loop(rows)
    assert {x[2] for x in got} == {"sent", "cooldown", "concurrency", "window", "ok", "unknown"}


def test_admission_by_hand():
    p, s = Policy(((2, 10.0),), concurrency=2, quiet=30.0), Pace()
    assert s.step(p, 0.0, "send", "a", None, False) == ("sent", 0.0)
    assert s.step(p, 1.0, "send", "b", None, False) == ("sent", 0.0)
    assert s.step(p, 1.0, "send", "c", None, False) == ("concurrency", 0.0)
    assert s.step(p, 2.0, "result", "a", 200, False) == ("ok", 0.0)
    assert s.step(p, 2.0, "send", "d", None, False) == ("window", 8.0)
    assert s.step(p, 3.0, "response", "b", 429, False) == ("ok", 0.0)
    assert s.step(p, 12.0, "send", "e", None, False) == ("cooldown", 21.0)
    assert s.step(p, 33.0, "send", "f", None, False) == ("sent", 0.0)
    assert s.step(p, 34.0, "result", "c", 200, False) == ("unknown", 0.0)


def test_odd_rows(spark):
    rows = [("a", 1, 0.0, "send", "x", None, None), ("a", 2, 1.0, None, "x", None, None), (None, 3, 1.0, "send", "y", None, None), ("a", 4, None, "result", "x", 200, None), ("a", 5, 2.0, "noise", "x", 200, None)]
    assert told(paced(spark.createDataFrame(rows, LOG), POLICY).collect()) == [("a", 1, "sent", 0.0, 1, None)]
    assert paced(spark.createDataFrame([], LOG), POLICY).count() == 0
    with pytest.raises(ValueError, match="one ticket"):
        paced(spark.createDataFrame([rows[0], ("a", 9, 5.0, "send", "x", None, None)], LOG), POLICY)


def test_the_stream_decides_late_rows_in_their_place(spark, tmp_path):
    rows = sorted(traffic(5, 240), key=lambda x: x[2])
    r = random.Random(7)
    third = len(rows) // 3
    batches = [rows[:third], rows[third : 2 * third], rows[2 * third :]]
    for k in (0, 1):  # some rows come a batch later, within the delay allowed
        slow = [x for x in batches[k] if x[2] > batches[k][-1][2] - 300 and r.random() < 0.4]
        batches[k] = [x for x in batches[k] if x not in slow]
        batches[k + 1] = slow + batches[k + 1]
    lost = ("a", 10**6, -5000.0, "send", "lost", None, None)
    batches.append([lost, ("end", 10**6 + 1, 10.0**7, "send", "end", None, None)])
    path = str(tmp_path / uuid.uuid4().hex)
    for k, batch in enumerate(batches):
        r.shuffle(batch)
        spark.createDataFrame(batch, LOG).coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path)
        out = paced_streamed(stream, POLICY, late="600 seconds")
        at = str(tmp_path / "out")
        query = out.writeStream.format("parquet").option("path", at).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        query.stop()
        got = told(spark.read.parquet(at).collect())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == loop(rows)


def test_breaker_with_probation(spark):
    r = random.Random(3)
    rows, at = [], 0.0
    for k in range(1500):
        at += r.choice([0.0, 1.0, 2.0, r.choice([6.0, 40.0])])
        rows.append((("x", "x", "y")[k % 3], k, at, r.choice([True, False, False, None]) if k % 200 > 60 else False))
    want, state = [], {}
    for key, seq, t, bad in rows:
        fails, until = state.get(key, (0, None))
        if until is not None and t < until:
            want.append((key, seq, "skipped", fails, until))
            continue
        phase = "called" if until is None else "probed"
        if bad is False:
            fails, until = 0, None
        else:
            fails += 1
            until = t + 10.0 if until is not None or fails >= 3 else None
        state[key] = fails, until
        want.append((key, seq, phase, fails, until))
    r.shuffle(rows)
    calls = spark.createDataFrame(rows, "backend string, seq long, at double, degraded boolean")
    assert told(probation_breaker(calls, trips=3, cooldown=10.0).collect()) == sorted(want)
    assert {x[2] for x in want} == {"skipped", "called", "probed"}
    assert {x["decision"] for x in probation_breaker(calls, trips=0).collect()} == {"called"}
