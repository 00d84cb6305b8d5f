"""Adoption of identifiers and DOIs found by title against plain loops over their claims."""

import random

import pytest

from lectern.operators.adoption import NAMES, adopted, adopted_records, dois_resolved, resolved_records

RECORD = "key string, ord int, source string, canonical string, blocked boolean, doi string, arxiv_id string, inspire_record_id string, paper_id string"
CLAIM = "id int, pos int, key string, name string, value string, completing boolean"
STUB = "key string, ord int, doi string, canonical string, merging boolean, venue string"


def token(name, value, source):
    value = (value or "").strip()
    if name == "inspire_record_id":
        return value.lstrip("0") if value.isdigit() else ""
    if name == "paper_id":
        return f"{'core:work' if source == 'core' else source}:{value}" if value and source else ""
    return value.lower() if name == "doi" else value


def loop(claims, records, reserved):
    records = {r["key"]: dict(r) for r in sorted(records, key=lambda r: r["ord"])}
    out = []
    for c in sorted(claims, key=lambda c: c["pos"]):
        name, key, r, holder = c["name"], c["key"], records.get(c["key"]), None
        if r is None:
            said = "refused-missing"
        elif r["canonical"] or r["blocked"] and not c["completing"]:
            said = "refused-blocked"
        elif not (t := token(name, c["value"], r["source"])):
            said = "refused-empty"
        elif any(n == name and v == t and k != key for n, v, k in reserved):
            said = "refused-reserved"
        else:
            owner = next((x["canonical"] or x["key"] for x in records.values() if x[name] and token(name, x[name], x["source"]) == t), None)
            if owner and owner != key:
                said, holder = "refused-held-by-other", owner
            elif r[name]:
                said = "already-mine" if token(name, r[name], r["source"]) == t else "refused-existing"
            else:
                r[name], said = c["value"], "adopted"
        out.append((c["id"], said, holder))
    return sorted(out), records


@pytest.mark.parametrize(("seed", "n"), [(1, 300), (2, 900)])
def test_adoption_is_first_come_first_served(spark, seed, n):
    r = random.Random(seed)

    def value(name):
        return r.choice([None, "", f"10.1000/{'aA'[r.random() < 0.3]}{r.randrange(n // 12)}" if name == "doi" else f"2001.{10000 + r.randrange(n // 12)}" if name == "arxiv_id" else f"0{r.randrange(n // 12)}"])

    records = [{"key": f"r{k}", "ord": k, "source": r.choice(["core", "local", None, ""]), "canonical": f"r{k - 1}" if k % 11 == 5 else None, "blocked": r.choice([True, False, False, False, None]), **{x: value(x) if r.random() < 0.4 else None for x in NAMES}} for k in range(n // 6)]
    claims = [{"id": k, "pos": k, "key": r.choice([f"r{r.randrange(n // 6)}", f"r{r.randrange(8)}", None if k % 50 == 0 else "r0"]), "name": r.choice(NAMES), "value": None, "completing": r.choice([True, False, None])} for k in range(n)]
    for c in claims:
        c["value"] = value(c["name"])
    reserved = [("doi", f"10.1000/a{k}", f"r{k * 2}") for k in range(4)] + [("doi", "10.1000/a1", "r3")]
    r.shuffle(claims)
    base = spark.createDataFrame(records, RECORD)
    got = adopted(spark.createDataFrame(claims, CLAIM).repartition(3), base, spark.createDataFrame(reserved, "name string, token string, key string"))
    want, after = loop(claims, records, reserved)
    rows = got.collect()
    assert sorted((x["id"], x["outcome"], x["holder"]) for x in rows) == want
    assert {x[1] for x in want} == {"refused-missing", "refused-blocked", "refused-empty", "refused-reserved", "refused-held-by-other", "already-mine", "refused-existing", "adopted"}
    assert {x["key"]: tuple(x[f] for f in NAMES) for x in adopted_records(base, got).collect()} == {k: tuple(v[f] for f in NAMES) for k, v in after.items()}


def test_a_chain_of_claims_and_one_value_that_all_want(spark):
    chain = [{"id": k, "pos": k, "key": f"r{(k + 1) // 2}", "name": "doi", "value": f"10.1000/{k // 2}", "completing": None} for k in range(8)]
    hot = [{"id": 100 + k, "pos": 100 + k, "key": f"r{10 + k}", "name": "arxiv_id", "value": "2001.00001", "completing": None} for k in range(60)]
    records = [{"key": f"r{k}", "ord": k} for k in range(80)]
    base, none = spark.createDataFrame([{**dict.fromkeys(x.split()[0] for x in RECORD.split(", ")), **r} for r in records], RECORD), spark.createDataFrame([], "name string, token string, key string")
    got = adopted(spark.createDataFrame(chain + hot, CLAIM), base, none).collect()
    whole = [{**dict.fromkeys(x.split()[0] for x in RECORD.split(", ")), **r} for r in records]
    assert sorted((x["id"], x["outcome"], x["holder"]) for x in got) == loop(chain + hot, whole, [])[0]
    assert adopted(spark.createDataFrame([], CLAIM), base, none).count() == 0


def resolve(claims, records):
    records = {r["key"]: dict(r) for r in sorted(records, key=lambda r: r["ord"])}
    index, out = {}, []
    for x in records.values():
        if x["doi"]:
            index.setdefault(x["doi"].lower(), x["canonical"] or x["key"])
    for c in sorted(claims, key=lambda c: c["pos"]):
        r, doi = records.get(c["key"]), (c["doi"] or "").strip()
        if r is None:
            said = ("no_paper", "")
        elif r["canonical"]:
            said = ("alias", r["canonical"])
        elif r["merging"]:
            said = ("merge_waiting", "")
        elif r["doi"]:
            said = ("has_doi", r["doi"])
        elif not doi:
            said = ("no_paper", "empty doi")
        else:
            holder = index.get(doi.lower())
            if holder and holder != r["key"] and records[holder]["merging"]:
                said = ("merge_waiting", holder)
            elif holder and holder != r["key"]:
                said, r["canonical"] = ("collision", holder), holder
                records[holder]["venue"] = records[holder]["venue"] or r["given"]
            else:
                said, r["doi"] = ("set", doi), doi
                index.setdefault(doi.lower(), r["key"])
        out.append((c["id"], *said))
    return sorted(out), records


@pytest.mark.parametrize("seed", [3, 4])
def test_dois_found_by_title(spark, seed):
    r, n = random.Random(seed), 160
    records = [{"key": f"r{k}", "ord": k, "doi": f"10.1000/x{r.randrange(60)}" if k % 3 == 0 else r.choice([None, ""]), "canonical": f"r{k - 1}" if k % 9 == 1 else None, "merging": r.choice([True, None, False, False, False, False]), "venue": r.choice([None, f"v{k}"])} for k in range(n)]
    claims = [{"id": k, "pos": k, "key": f"r{r.randrange(n + 8)}", "doi": r.choice([None, " ", *[f" 10.1000/{'xX'[k % 2]}{r.randrange(90)}"] * 5])} for k in range(700)]
    r.shuffle(claims)
    base = spark.createDataFrame(records, STUB)
    got = dois_resolved(spark.createDataFrame(claims, "id int, pos int, key string, doi string"), base)
    want, after = resolve(claims, [{**x, "given": x["venue"]} for x in records])
    assert sorted((x["id"], x["outcome"], x["detail"]) for x in got.collect()) == want
    assert {x[1] for x in want} == {"no_paper", "alias", "merge_waiting", "has_doi", "collision", "set"}
    assert {x["key"]: (x["doi"] or "", x["canonical"], x["venue"]) for x in resolved_records(base, got, ("venue",)).collect()} == {k: (v["doi"] or "", v["canonical"], v["venue"]) for k, v in after.items()}
