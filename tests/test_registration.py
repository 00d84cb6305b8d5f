"""Registration of batches against a plain loop over their candidates."""

import random

import pytest

from lectern.operators.registration import filled_records, registered

IDENTITY = "doi string, arxiv string, version string, title string"


def agree(a, b):
    if a["doi"] and b["doi"]:
        return a["doi"] == b["doi"]
    return not (a["arxiv"] and b["arxiv"] and a["arxiv"] != b["arxiv"]) and not (a["version"] and b["version"] and a["version"] != b["version"])


def in_order(candidates, records, aliases):
    """One candidate after another; an index keeps the first record to hold a value."""
    state, index, out = {}, {}, []

    def hold(name, seen):
        own = state.setdefault(name, dict.fromkeys(("doi", "arxiv", "version", "title")))
        for f in ("doi", "arxiv", "title"):
            if seen[f] and not own[f]:
                own[f] = seen[f]
                if f == "arxiv":
                    own["version"] = seen["version"] or None
                index.setdefault((f, seen[f]), name)

    for r in sorted(records, key=lambda r: r["ord"]):
        hold(r["record"], r)
    for c in sorted(candidates, key=lambda c: c["pos"]):
        found = None
        for f in ("doi", "arxiv", "title"):
            if not c[f]:
                continue
            if f != "title":
                hit = next((a["record"] for a in sorted(aliases, key=lambda a: a["ord"]) if a[f] == c[f] and agree(a, c)), None)
                if hit:
                    found = (hit, "alias_" + f)
                    break
            hit = index.get((f, c[f]))
            if hit and agree(state[hit], c):
                found = (hit, f)
                break
        if not found:
            found = ("new:" + c["id"], "new") if c["valid"] else (None, "rejected")
        if found[0]:
            hold(found[0], c)
        out.append((c["id"], *found))
    return sorted(out), state


def batch(seed, n):
    r = random.Random(seed)

    def identity():
        arxiv = r.choice([None, "", f"a{r.randrange(n // 5)}", f"a{r.randrange(n // 5)}"])
        return {"doi": r.choice([None, "", f"d{r.randrange(n // 5)}", f"d{r.randrange(n // 5)}"]), "arxiv": arxiv, "version": r.choice([None, "v1", "v2"]) if arxiv else None, "title": r.choice([None, *(f"t{k}" for k in range(n // 6))])}

    records, taken = [], set()
    for k in range(n // 6):
        own = identity()
        for f in ("doi", "arxiv", "title"):
            if own[f] and (f, own[f]) in taken:
                own[f] = None
            taken.add((f, own[f]))
        own["version"] = own["version"] if own["arxiv"] else None
        records.append({"record": f"r{k}", "ord": k, **own})
    aliases = [{"ord": k, **identity(), "record": f"r{r.randrange(len(records))}"} for k in range(n // 10)]
    candidates = [{"id": f"c{k}", "pos": k, **identity(), "valid": r.random() < 0.7} for k in range(n)]
    r.shuffle(candidates)
    return candidates, records, aliases


@pytest.mark.parametrize(("seed", "n"), [(1, 60), (2, 150)])
def test_batches_are_registered_as_in_order(spark, seed, n):
    candidates, records, aliases = batch(seed, n)
    frames = (
        spark.createDataFrame(candidates, f"id string, pos int, {IDENTITY}, valid boolean"),
        spark.createDataFrame(records, f"record string, ord int, {IDENTITY}"),
        spark.createDataFrame(aliases, f"ord int, {IDENTITY}, record string"),
    )
    want, state = in_order(candidates, records, aliases)
    got = registered(*frames)
    assert sorted((x["id"], x["record"], x["rung"]) for x in got.collect()) == want
    assert {x[2] for x in want} >= {"doi", "arxiv", "title", "new", "rejected", "alias_doi"}
    after = {x["record"]: x.asDict() for x in filled_records(frames[0], frames[1], got).collect()}
    assert set(after) == set(state)
    assert all((after[k]["doi"], after[k]["arxiv"], after[k]["title"]) == (v["doi"], v["arxiv"], v["title"]) for k, v in state.items())


def test_a_batch_of_one_title_and_many_identities(spark):
    candidates = [{"id": f"c{k}", "pos": k, "doi": f"d{k}" if k % 3 else None, "arxiv": None, "version": None, "title": "same", "valid": True} for k in range(60)]
    df = spark.createDataFrame(candidates, f"id string, pos int, {IDENTITY}, valid boolean")
    none = spark.createDataFrame([], f"record string, ord int, {IDENTITY}"), spark.createDataFrame([], f"ord int, {IDENTITY}, record string")
    assert sorted((x["id"], x["record"], x["rung"]) for x in registered(df, *none).collect()) == in_order(candidates, [], [])[0]
    assert registered(df.limit(0), *none).count() == 0


def test_rounds_write_what_a_block_adds_and_no_candidates(spark, monkeypatch):
    from lectern.operators import registration

    written = []

    def told(df, name, saved=registration.saved):
        out = saved(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(registration, "saved", told)
    monkeypatch.setattr(registration, "FIRST", 60, raising=False)
    few, records, aliases = batch(3, 60)
    # the later candidates bring what is held already; one alias names a record that the batch makes, many share an arXiv id
    candidates = few + [{**c, "id": f"{c['id']}.{k}", "pos": c["pos"] + 60 * k} for k in range(1, 10) for c in few]
    aliases += [{"ord": 100 + k, "doi": None if k % 2 else f"d{k}", "arxiv": "a1", "version": f"v{k}" if k % 3 else None, "title": None, "record": f"new:c{k % 9}"} for k in range(60)]
    frames = (
        spark.createDataFrame(candidates, f"id string, pos int, {IDENTITY}, valid boolean"),
        spark.createDataFrame(records, f"record string, ord int, {IDENTITY}"),
        spark.createDataFrame(aliases, f"ord int, {IDENTITY}, record string"),
    )
    got = registered(*frames)
    assert sorted((x["id"], x["record"], x["rung"]) for x in got.collect()) == in_order(candidates, records, aliases)[0]
    assert sum(written) < 3 * len(candidates) and max(written) == len(candidates)
