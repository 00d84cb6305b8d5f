"""The command reducer against a plain fold, split or whole, in batch or on a stream."""

import random

import numpy as np
import pytest

from lectern.operators import commands as C

LOG = "operation_id string, unit string, seq long, action string, token long, payload string"


def plain(commands):
    """(accepted, phase, failures, quarantined, holder) of each command of one unit, by its rules one by one."""
    phase, failures, held, holder, out = "absent", 0, False, None, []
    for action, token in commands:
        live = phase in ("running", "retiring", "sealed")
        own = token is not None and token == holder
        ok = False
        if action == "enqueue":
            ok, phase = True, "queued" if phase == "absent" else phase
        elif action in ("claim", "rebase"):
            ok = not held and failures < 3 and (phase in ("queued", "failed") or action == "rebase" and phase in ("succeeded", "published"))
            phase, holder = ("running", token) if ok else (phase, holder)
        elif action == "renew":
            ok = own and live
        elif action in ("accept_submission", "record_tombstone"):
            ok = own and phase in ("running", "retiring")
        elif action == "begin_retirement":
            ok = own and phase == "running"
            phase = "retiring" if ok else phase
        elif action == "seal_namespace":
            ok = own and live
            phase = "sealed" if ok else phase
        elif action == "complete":
            ok = own and phase in ("sealed", "succeeded", "publishing")
            if ok and phase == "sealed":
                phase, failures = "succeeded", 0
        elif action == "defer_attempt":
            ok = own and phase in ("running", "retiring")
            phase = "queued" if ok else phase
        elif action in ("fail", "expire_attempt", "fail_retirement"):
            ok = own and live and (action != "fail_retirement" or phase != "sealed")
            phase, failures = ("failed", min(3, failures + 1)) if ok else (phase, failures)
        elif action == "cancel":
            ok = own and live
            phase = "cancelled" if ok else phase
        elif action == "claim_publication":
            ok = not held and phase == "succeeded"
            phase = "publishing" if ok else phase
        elif action == "publish_derivation":
            ok = own and not held and phase == "publishing"
            phase = "published" if ok else phase
        elif action == "reset_reducer":
            ok = not live and phase != "absent"
            failures = 0 if ok else failures
        elif action in ("quarantine", "clear_quarantine"):
            ok, held = True, action == "quarantine"
        out.append((ok, phase, failures, held, holder))
    return out


def commands(r, n):
    """A likely history with stale tokens, odd actions and lawless steps among it."""
    out, fresh = [], 0
    for _ in range(n):
        usual = ["enqueue", "claim", "claim", "rebase", *["seal_namespace", "complete", "claim_publication", "publish_derivation"] * 3, "fail", "reset_reducer", "clear_quarantine", "unheard_of"]
        action = r.choice([*usual, *(x for x in C.ACTIONS if x not in ("cancel", "quarantine"))])
        action = "cancel" if r.random() < 0.003 else "quarantine" if r.random() < 0.02 else action
        fresh += action in C.CLAIMS
        holder = plain(out)[-1][4] if out else None
        out.append((action, fresh if action in C.CLAIMS else r.choice([holder, holder, holder, r.randrange(fresh + 1), None])))
    return out


def test_runs_compose():
    r = random.Random(1)
    for n in (1, 7, 60):
        log = commands(r, n)
        a = np.array([C.ACTIONS.index(x) if x in C.ACTIONS else -1 for x, _ in log])
        t = np.array([-1 if x is None else x for _, x in log])
        want = C.replay(a, t, C.START, C.NOBODY)
        for cut in range(0, n, 5):
            state, token = C.follow(C.summed(a[:cut], t[:cut]), C.START, C.NOBODY)
            assert C.follow(C.summed(a[cut:], t[cut:]), state, token) == (want[1][-1], want[2][-1])
        for state in range(C.STATES):
            for token in (-1, 0, 3, 99):
                got = C.replay(a, t, state, token)
                assert C.follow(C.summed(a, t), state, token) == (got[1][-1], got[2][-1])


def history(seed):
    r = random.Random(seed)
    rows, want, seq = [], {}, 0
    logs = {"hot": commands(r, 900), "stopped": [("enqueue", None), ("claim", 4), ("cancel", 4), ("claim", 5)], "failing": [("enqueue", None)] + [("claim", k) if k % 2 else ("fail", k - 1) for k in range(1, 9)], **{f"u{k}": commands(r, r.randrange(1, 40)) for k in range(12)}}
    left = {u: list(x) for u, x in logs.items()}
    while any(left.values()):
        u = r.choice([x for x in left if left[x]])
        action, token = left[u].pop(0)
        rows.append((f"o{seq}", u, seq, action, token, f"p{seq % 5}"))
        seq += 1
    for u, log in logs.items():
        own = [x for x in rows if x[1] == u]
        want |= {x[0]: (u, *told) for x, told in zip(own, plain(log), strict=True)}
    again = [(*x[:2], seq + k, *x[3:]) for k, x in enumerate(r.sample(rows, 80))]  # replayed operations change nothing
    rows += again
    r.shuffle(rows)
    return rows, want


@pytest.mark.parametrize("run", [64, 10_000])
def test_commands_are_reduced_as_by_a_plain_fold(spark, run):
    rows, want = history(run)
    got = {x["operation_id"]: (x["unit"], x["accepted"], x["phase"], x["failures"], x["quarantined"], x["holder"]) for x in C.commands_reduced(spark.createDataFrame(rows, LOG).repartition(3), run).collect()}
    assert got == want
    assert {x[2] for x in got.values()} == set(C.PHASES) and any(x[3] == 3 for x in got.values())


def test_an_operation_with_other_content_raises(spark):
    rows = [("a", "u", 1, "enqueue", None, "x"), ("a", "u", 2, "enqueue", None, "y")]
    with pytest.raises(Exception, match="other content: a"):
        C.commands_reduced(spark.createDataFrame(rows, LOG)).collect()
    assert C.commands_reduced(spark.createDataFrame([], LOG)).count() == 0


def test_the_stream_agrees_with_the_batch(spark, tmp_path):
    rows, want = history(5)
    rows.sort(key=lambda x: x[2])
    half = [x for x in rows if x[2] < 500], [x for x in rows if x[2] >= 500]
    for k, part in enumerate(half):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(LOG).parquet(str(tmp_path / "log"))
        out = C.commands_streamed(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        out.awaitTermination()
    got = {x["operation_id"]: (x["unit"], x["accepted"], x["phase"], x["failures"], x["quarantined"], x["holder"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want
