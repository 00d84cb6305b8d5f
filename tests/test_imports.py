"""Imports of a ledger against a plain replay."""

import random
from collections import Counter, defaultdict

import pytest

from lectern.operators.imports import checked_changes, import_events, import_sets

ROW = "struct<row_id:string,doc:string,failures:int>"


def history(r, n=120):
    """A snapshot and changes that follow it, some of which change a row's identity."""
    rows = {f"r{i}": (f"r{i}", f"d{r.randrange(6)}", r.randrange(-1, 4)) for i in range(10)}
    start, live, changes = dict(rows), dict(rows), []
    for k in range(n):
        name, free = r.choice([*live, None]), f"r{r.randrange(25)}"
        new = (free, f"d{r.randrange(8)}", r.choice([None, -1, 0, 2]))
        if name is None or not live:
            if free in live:
                free = f"n{k}"
            new = (free, *new[1:])
            changes.append((k + 1, "INSERT", None, new))
            live[free] = new
        elif r.random() < 0.3:
            changes.append((k + 1, "DELETE", live.pop(name), None))
        else:
            old = live.pop(name)
            new = (free if free not in live and r.random() < 0.4 else name, *new[1:])
            changes.append((k + 1, "UPDATE", old, new))
            live[new[0]] = new
    return list(start.values()), changes


def replayed(snapshot, changes, mappings, statuses):
    units, said = defaultdict(list), Counter(statuses)
    for row, unit in mappings:
        units[row].append(unit)
    live = {x[0]: x for x in snapshot}
    out = []

    def tell(sequence, operation, row, deleted):
        own, docs = units[row[0]], Counter(x[1] for x in live.values())
        of = Counter(u for x in live for u in set(units[x]))
        what = ["matched" if said[row[1]] else "ledger_only"]
        what += ["conflicting_mapping"] * (len(own) > 1) + ["unmatched_unit"] * (not own)
        what += ["duplicate_unit"] * (len(own) == 1 and of[own[0]] > 1) + ["duplicate_document_identity"] * (docs[row[1]] > 1) + ["duplicate_docstatus"] * (said[row[1]] > 1)
        what += ["provenance_gap"] + ["source_deleted"] * deleted + ["invalid_failure_counter"] * (row[2] is None or row[2] < 0)
        out.append((row[0], sequence, operation, deleted, row[1], own[0] if len(own) == 1 else None, tuple(what)))

    for row in snapshot:
        tell(0, "SNAPSHOT", row, False)
    for sequence, operation, old, new in changes:
        if old:
            del live[old[0]]
        if new:
            live[new[0]] = new
        if old and (new is None or old[0] != new[0]):
            tell(sequence, "DELETE", old, True)
        if new:
            tell(sequence, operation, new, False)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_events_are_judged_after_their_change(spark, seed):
    r = random.Random(seed)
    snapshot, changes = history(r)
    mappings = [(f"r{i}", f"u{i % 5}") for i in range(20)] + [("r3", "u1"), ("r4", "u4"), ("n5", "u2")]
    statuses = ["d0", "d1", "d1", "d7", "gone", "gone", "once"]
    args = (spark.createDataFrame(snapshot, "row_id string, doc string, failures int"), spark.createDataFrame(changes, f"sequence long, operation string, old {ROW}, new {ROW}"))
    rest = (spark.createDataFrame(mappings, "row_id string, unit_id string"), spark.createDataFrame([(x,) for x in statuses], "doc string"))
    events = import_events(*args, *rest)
    want = replayed(snapshot, changes, mappings, statuses)
    got = [(x["row_id"], x["sequence"], x["operation"], x["deleted"], x["doc"], x["unit_id"], tuple(x["dispositions"])) for x in events.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)

    last = {}
    for e in want:
        last[e[0]] = e
    sets = Counter()
    for e in last.values():
        names = {"matched": "matches", "ledger_only": "ledger_only", "provenance_gap": "provenance_gaps", "conflicting_mapping": "conflicts", "invalid_failure_counter": "conflicts"}
        for name in {names[x] for x in e[6] if x in names} | {"duplicates" for x in e[6] if x.startswith("duplicate")}:
            sets[name, e[0], e[4]] += 1
    live = {e[4] for e in last.values() if not e[3]}
    for doc in statuses:
        if doc not in live:
            sets["docstatus_only", None, doc] += 1
    for doc, n in Counter(statuses).items():
        if n > 1 and doc not in live:
            sets["duplicates", None, doc] += 1
    assert Counter((x["name"], x["row_id"], x["doc"]) for x in import_sets(events, rest[1]).collect()) == sets


def test_broken_histories_raise(spark):
    snapshot = spark.createDataFrame([("a", "1")], "row_id string, image string")

    def check(*changes, end=None):
        checked_changes(snapshot, spark.createDataFrame(changes, "sequence long, operation string, old_id string, old_image string, new_id string, new_image string"), 5, end)

    good = [(6, "UPDATE", "a", "1", "b", "2"), (7, "INSERT", None, None, "a", "3"), (8, "DELETE", "b", "2", None, None), (9, "UPDATE", "a", "3", "a", "4")]
    check(*good, end=9)
    for change, why in [((10, "DELETE", "a", "3", None, None), "old image"), ((10, "INSERT", None, None, "a", "9"), "exists"), ((10, "UPDATE", "b", "2", "b", "3"), "old image"), ((11, "DELETE", "a", "4", None, None), "gap"), ((9, "DELETE", "a", "4", None, None), "gap"), ((10, "MOVE", "a", "4", "c", "4"), "unknown"), ((10, "UPDATE", "a", "4", None, None), "no new"), ((10, "DELETE", None, None, None, None), "no old")]:
        with pytest.raises(ValueError, match=why):
            check(*good, change)
    with pytest.raises(ValueError, match="gap"):
        check(*good, end=10)
