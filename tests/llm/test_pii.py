import hashlib
import re

from lectern.llm.pii import KINDS, detected, digest, personal_data, sanitised

# the detectors as they are specified, for the brute-force comparison
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def passes(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    return {"email": True, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def brute(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(PLAIN[k], text or "") if passes(k, m.group())] for k in KINDS}


ROWS = [
    (1, "mail a.b+c@x-y.example.com, or a@b.c_d@e.f and é@x.y z@1.2.3.4.5 ..@a.b"),
    (2, "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255 256.1.1.1 12.34.56 1.2.3.4"),
    (3, "4111 1111 1111 1111 and 4111111111111112; 4111-1111-1111-1111 5, 1 2 3"),
    (4, "+1 (068) 555-2748 +12 +44 20 7946 0958 0958 0958 +1(((((( +49.30.1234567."),
    (5, None), (6, ""), (7, "no data at all"), (8, "é東京 x@y.zz 🙂 +33 1 23 45 67 89 and 10.0.0.1"),
    (9, "a" * 200000), (10, ("q@w.ee 1.1.1.1 " * 3000)), (11, "1" * 50000), (12, "a." * 40000 + "@"), (13, "x@" + "a." * 20000), (13, "x@" + "a." * 20000), (None, "k@l.mm"),
]


def test_base_spans_match_brute_force(spark, docs):
    got = digest(personal_data(docs(ROWS))).collect()
    want = {i: brute(t) for i, t in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        own = want[r["doc_id"]]
        assert [r[f"n_{k}"] for k in KINDS] == [len(own[k]) for k in KINDS], r["doc_id"]
        text = ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in own[k])
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["spans"].startswith(text)
    assert digest(personal_data(docs([]))).count() == 0


def terms(row, text):
    return [text[int(a) : int(b)] for a, b in re.findall(r"term:(\d+):(\d+)", row["spans"])]


def test_terms_that_give_an_entity_away_are_found(spark, docs):
    rows = [(i, f"In year {i} the chief Zorblatt wrote to boss@corp.example on day {i} of the war.") for i in range(8)]
    rows += [(100 + i, f"The chief wrote a text on day {i} of the war, and of the peace in year {i} ago.") for i in range(300)]
    got = {r["doc_id"]: r for r in digest(personal_data(docs(rows))).collect()}
    for i in range(8):
        assert terms(got[i], rows[i][1]) == ["Zorblatt"]
    assert not any(terms(got[100 + i], rows[8 + i][1]) for i in range(300))


def test_copies_of_one_text_are_no_evidence(spark, docs):
    rows = [(i, "The chief Zorblatt wrote to boss@corp.example on a day.") for i in range(8)] + [(100 + i, "Nothing here.") for i in range(50)]
    assert not [r for r in digest(personal_data(docs(rows))).collect() if "term" in r["spans"]]


def test_sanitised_texts(spark, docs):
    rows = [(i, f"Year {i}: chief Zorblatt wrote to boss@corp.example on day {i} of it.") for i in range(8)] + [(100 + i, "The chief wrote on a day in that year .") for i in range(100)] + [(500, None)]
    out = sanitised(docs(rows))
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert out.columns == docs([]).columns and got[500] is None and got[100] == "The chief wrote on a day in that year ."
    assert got[3] in ("Year 3: chief  wrote to [EMAIL] on day 3 of it.", "Year 3: chief [NAME] wrote to [EMAIL] on day 3 of it.")


def test_rare_entities_have_terms_and_all_their_occurrences_are_marked(spark, docs):
    rows = [(1, "Zorblatt wrote to boss@corp.example, then a@b.cc left"), (2, "Zorblatt: he " + "far off " * 30 + "and at last came Zorblatt"), (4, "ask c@d.ee or Quuxley")]
    rows += [(100 + i, f"Then came the war, and he left or wrote: ask of it at last in year {i}, far off.") for i in range(3000)]
    got = {r["doc_id"]: r for r in digest(personal_data(docs(rows))).collect()}
    assert [terms(got[i], t) for i, t in rows[:3]] == [["Zorblatt"], ["Zorblatt"] * 2, ["Quuxley"]]
    assert not any(terms(got[i], t) for i, t in rows[3:])
    out = {r["doc_id"]: r["text"] for r in sanitised(docs(rows)).where("doc_id < 100").collect()}
    assert not any("Zorblatt" in t or "Quuxley" in t for t in out.values())


def test_contexts_reach_past_other_entities_and_to_the_text_s_edges(spark, docs):
    row = detected(docs([(1, "Chief a@b.cc x@y.zz boss@corp.example of all"), (2, "x" * 90 + " q@w.ee " + "y" * 90), (3, "k@l.mm " * 40)]), "doc_id", "text").collect()
    got = {r["id"]: [(x["left"], x["right"]) for x in r["email"]] for r in row}
    assert got[1][2] == (" Chief a@b.cc x@y.zz ", " of all ") and got[1][0] == (" Chief ", " x@y.zz boss@corp.example of all ")
    assert got[2] == [("x" * 79 + " ", " " + "y" * 79)]
    text = " " + "k@l.mm " * 40 + " "
    assert got[3] == [(text[max(0, 7 * i - 79) : 7 * i + 1], text[7 * i + 7 :][:80]) for i in range(40)]


def test_columns_of_any_name_pass_through(spark, docs):
    names = ["_key", "_cuts", "key", "row", "cuts", "a.b"]
    rows = docs([(1, "mail a@b.com now"), (2, None), (3, "nothing")]).selectExpr("*", *[f"doc_id * 10 + {i} AS `{n}`" for i, n in enumerate(names)])
    got = {r["doc_id"]: r for r in sanitised(rows).collect()}
    for i, r in got.items():
        assert [r[n] for n in names] == [10 * i + k for k in range(len(names))]
    assert got[2]["text"] is None and "[EMAIL]" in got[1]["text"]


def test_disclosing_terms_match_brute_force(spark, docs):
    import math
    import random

    r = random.Random(2)
    common = ["able", "baker", "candle", "donkey", "engine", "forest"]
    secret = {f"user{k}@site{k}.org": f"Nickname{'abcdefgh'[k]}" for k in range(8)}
    rows = []
    for i in range(120):
        words = [r.choice(common) for _ in range(r.randint(3, 9))]
        if i % 6 == 0:
            mail, name = list(secret.items())[(i // 6) % 8]
            words[1:1] = [name, "wrote", mail] if i % 12 else [name, mail]
        elif i % 17 == 0:
            words.insert(2, list(secret.values())[i % 8])
        rows.append((i, " ".join(words) + " ."))
    got = personal_data(docs(rows)).collect()
    found = {row["id"]: {x["value"] for x in row["email"]} for row in got}
    text = dict(rows)

    def terms(t):
        return {w.rstrip(".,;:!?").lower() for w in t.split() if re.fullmatch(r"[^\W\d_]{3,}[.,;:!?]{0,3}", w)}

    n = len(rows)
    n_t, n_e, contexts = {}, {}, {}
    for i, t in rows:
        for w in terms(t):
            n_t[w] = n_t.get(w, 0) + 1
        for e in found[i]:
            n_e[e] = n_e.get(e, 0) + 1
            at = t.index(e)
            left, right = (" " + t[:at])[-80:], (t[at + len(e) :] + " ")[:80]
            near = {m.lower() for side in (left, right) for m in re.findall(r"(?<=\s)[^\W\d_]{3,}(?=[.,;:!?]{0,3}\s)", side)}
            for w in near:
                contexts.setdefault((e, w), set()).add((left, right))
    share = {}
    for (e, w), seen in contexts.items():
        content = math.log2(n / n_e[e])
        p = (min(len(seen), n_t[w]) + 1) / (n_t[w] + 2)
        share[w] = max(share.get(w, 0), (content + math.log2(p)) / content)
    chosen = {w for w, s in share.items() if s >= 0.9}
    assert chosen and not chosen & set(common)
    for row in got:
        want = sorted((m.start(), m.end()) for m in re.finditer(r"(?<!\S)[^\W\d_]{3,}(?=[.,;:!?]{0,3}(?:\s|$))", text[row["id"]]) if m.group().lower() in chosen)
        assert [(x["start"], x["end"]) for x in row["term"]] == want


def test_terms_stand_where_a_search_of_the_text_finds_them(spark, docs, monkeypatch):
    from pyspark.sql import functions as F

    from lectern.llm import pii

    wanted = {"zorblatt": 0.95, "quuxley": 0.99, "éclair": 0.91}
    long = " ".join(f"Zorblatt{'' if i % 3 else 'x'} word{'' if i % 5 else ' Éclair,'} 12 \n🙂" for i in range(20000))
    rows = [(1, "Zorblatt, QUUXLEY! (zorblatt) zorblatt."), (1, "Zorblatt, QUUXLEY! (zorblatt) zorblatt."), (2, None), (3, ""), (4, "nothing here"), (5, long), (None, "éclair")]
    rows += [(6, " quuxley "), (6, "quuxley")]
    table = docs(rows)
    shares = spark.createDataFrame(list(wanted.items()), "term string, share double").select(F.xxhash64("term").alias("word"), "share")
    want = {}
    for i, t in set(rows):
        hits = [(m.start(1), m.end(1)) for m in re.finditer(r"(?:(?<=\s)|^)([^\W\d_]{3,})(?=[.,;:!?]{0,3}(?:\s|$))", t or "")]
        hits = [(a, b, wanted[t[a:b].lower()]) for a, b in hits if t[a:b].lower() in wanted]
        want.setdefault((i, t), hits) if hits else None
    for few in (pii._FEW, 1):  # by broadcast, and by a join
        monkeypatch.setattr(pii, "_FEW", few)
        got = pii.everywhere(table, pii.distinct_words(table, "doc_id", "text"), shares, "doc_id", "text").collect()
        by_key = {}
        for r in got:
            by_key.setdefault(r["key"], []).append((r["start"], r["end"], r["share"]))
        keys = {(r["doc_id"], r["text"]): r["key"] for r in table.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key")).collect()}
        assert {k: sorted(v) for k, v in by_key.items()} == {keys[k]: v for k, v in want.items()}
