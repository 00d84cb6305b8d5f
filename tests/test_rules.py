"""Results held against plain re-statements of their rules."""

import difflib
import itertools
import json
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import python as P
from lectern.operators import catalog as C
from lectern.operators import graphs as G
from lectern.operators import ledgers as L
from lectern.operators import matching as M
from lectern.operators import ranking as K
from lectern.operators import records as D
from lectern.operators import sync as S
from lectern.sources import files, payloads
from lectern.sources.html import page_links


# Texts


def plain_sentences(text):
    """Character by character."""
    out = []
    for paragraph in re.split(r"\n\s*\n", text):
        paragraph, last = paragraph.strip(), 0
        for i, c in enumerate(paragraph):
            rest = paragraph[i + 1 :].lstrip("\"')]")
            if c not in ".!?" or not rest or not rest[0].isspace():
                continue
            if c == ".":
                if i and paragraph[i - 1].isdecimal():
                    continue
                k = i
                while k and re.match(r"[A-Za-z.\-]", paragraph[k - 1]):
                    k -= 1
                word = re.sub(r"^[.\-]*", "", paragraph[k:i]).rstrip(".").lower()
                if word in P.ABBREVIATIONS or len(word) == 1:
                    continue
            out.append(paragraph[last : i + 1].strip())
            last = i + 1
        out.append(paragraph[last:].strip())
    return [s for s in out if s]


PARTS = ["Next", " ", " ", ".", "!", "?", "et al", "Fig", "e.g", "km", "J", "3", "0.5", '"', ")", "\n", "\n\n", "-", "word.", "é", "No. ", "end. ", "deg"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=25))
def test_sentences_match_a_scan_by_characters(parts):
    text = "".join(parts)
    assert P.sentences(text) == plain_sentences(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=25), st.integers(4, 20), st.integers(0, 12))
def test_chunks_are_greedy_ranges_of_sentences(lengths, size, overlap):
    words = [f"{'abcdefghij'[i % 10] * n}X{i}!" for i, n in enumerate(lengths)]
    text = " ".join(words)
    assert P.sentences(text) == words
    sizes = [P.estimate(w) for w in words]
    done, last = 0, None  # sentences given so far; the last chunk as a range
    chunks = P.pack_sentences(text, size, overlap)
    assert [c["chunk_order_index"] for c in chunks] == list(range(len(chunks)))
    it = iter(chunks)
    while done < len(words):
        if sizes[done] > size:
            width, step = 4 * size, 4 * max(1, size - overlap)
            at = 0
            while True:
                assert next(it)["content"] == words[done][at : at + width]
                if at + width >= len(words[done]):
                    break
                at += step
            done, last = done + 1, None
            continue
        carried = []
        if last and overlap:
            for k in range(last[1] - 1, last[0], -1):  # never all of the chunk before
                if carried and sum(sizes[j] for j in carried) + sizes[k] > overlap:
                    break
                carried.insert(0, k)
        first = carried[0] if carried else done
        end = done + 1
        while end < len(words) and sizes[end] <= size and P.estimate(" ".join(words[first : end + 1])) <= size:
            end += 1
        chunk = next(it)
        assert chunk["content"] == " ".join(words[first:end]) and chunk["tokens"] == P.estimate(chunk["content"])
        done, last = end, (first, end)
    assert next(it, None) is None


def test_chunks_count_by_a_tokenizer():
    class Words:
        encode = staticmethod(str.split)
        decode = staticmethod(" ".join)

    got = P.pack_sentences("One two three. Four five six. Seven eight. " + "nine " * 9 + ".", 6, 3, Words)
    assert [(c["tokens"], c["content"]) for c in got[:2]] == [(6, "One two three. Four five six."), (5, "Four five six. Seven eight.")]
    assert [c["tokens"] for c in got[2:]] == [6, 6, 4][: len(got) - 2]


def test_sections_start_at_headings():
    text = "Intro.\n\n# One\n\n" + "Word. " * 40 + "\n## Two\nShort.\n### Three\nMore."
    got = P.sections(text, 20)
    assert [g["section_id"] for g in got] == [f"#s{i + 1}" for i in range(len(got))]
    assert got[0]["content"] == "Intro." and got[-1]["content"] == "## Two\nShort.\n\n### Three\nMore."
    assert all(P.estimate(g["content"]) <= 20 for g in got)
    assert P.sections("Just a text.") == [{"section_id": "", "content": "Just a text."}]


@pytest.mark.parametrize("heading", ["Acknowledgments", "5. Funding", "VII ACKNOWLEDGEMENTS", "Declaration of competing interest", "Competing interest", "Author contribution", "Data availability statement", "Compliance with ethical standards", "Disclosure", "Conflict of interest"])
@pytest.mark.parametrize("indent", ["", "  "])
def test_closing_headings(heading, indent):
    body = "# Study\n\n" + "Findings of weight. " * 12
    assert P.without_closing(f"{body.strip()}\n\n{indent}## {heading}\nWe thank.\n\n## Appendix\nMore.") == f"{body.strip()}\n\n## Appendix\nMore."
    assert P.without_closing(f"{body.strip()}\n\n{indent}## {heading}\nWe thank.") == body.strip()


def test_closing_sections_that_stay():
    body = "Findings of weight. " * 12
    for kept in (f"{body}\n\n## Fundingx\nText.", f"{body}\n\n## Funding\nTABLE I: values\n\n## End\nx", f"{body}\n\n## Funding\n$$x$$", f"## Funding\n{body}", f"{body[:40]}\n\n## Funding\n{body}\n\n## End\nx"):
        assert P.without_closing(kept) == kept
    several = f"{body.strip()}\n\n## Funding\na.\n\n## Disclosure\nb.\n\n## Results\nc.\n\n## Acknowledgements\nd."
    assert P.without_closing(several) == f"{body.strip()}\n\n## Results\nc."


# Chains, borders, covers


def test_alias_chains_of_any_length(spark):
    links = [(f"k{i}", f"k{i + 1}") for i in range(100)] + [("a", "b"), ("b", "a"), ("c", "a"), ("s", "s")]
    df = spark.createDataFrame(links, "key string, target string")
    got = {r["key"]: (r["root"], r["is_cycle"]) for r in M.alias_chase(df).collect()}
    assert all(got[f"k{i}"] == ("k100", False) for i in range(100))
    assert all(got[k] == (None, True) for k in "abcs")
    with pytest.raises(ValueError):
        M.alias_chase(df, strict=True)
    assert M.alias_chase(df.limit(0)).count() == 0


def test_breaker_counts_a_failure_at_the_border(spark):
    def states(times):
        df = spark.createDataFrame([("a", i, float(x), True) for i, x in enumerate(times)], "k string, seq long, at double, failed boolean")
        return [r["state"] for r in L.sliding_breaker(df, "k", "at", "failed", 2, 100.0, 50.0).orderBy("seq").collect()]

    assert states([0, 100]) == ["CLOSED", "OPEN"] and states([0, 100.5]) == ["CLOSED", "CLOSED"]


def best_cover(masks, groups, limit):
    able = [i for i, m in enumerate(masks) if m]
    every = (c for n in range(min(limit, groups) + 1) for c in itertools.combinations(able, n))

    def rank(ids):
        have = 0
        for i in ids:
            have |= masks[i]
        return [not have >> g & 1 for g in range(groups)], sum(i >= limit for i in ids), len(ids), sum(ids), ids

    chosen = set(min(every, key=rank))
    for i in range(len(masks)):
        if len(chosen) < min(limit, len(masks)):
            chosen.add(i)
    return sorted(chosen) + [i for i in range(len(masks)) if i not in chosen]


def test_named_cover_is_the_best_of_all_sets(spark):
    r = random.Random(3)
    cases, data = {}, []
    for q in range(60):
        masks = [r.choice([0, 0, 1, 2, 4, 3, 6, 5]) for _ in range(r.randint(1, 12))]
        cases[q] = masks
        data += [(q, i, 10 * i, m, 0.9 if m else 0.2) for i, m in enumerate(masks)]
    df = spark.createDataFrame(data, "qid int, key int, rank int, mask int, score double")
    for limit in (1, 2, 4):
        got = {}
        for x in K.named_cover(df, 3, limit).orderBy("qid", "rank").collect():
            got.setdefault(x["qid"], []).append(x["key"])
        assert got == {q: best_cover(m, 3, limit) for q, m in cases.items()}


def test_ranks_over_all_rows(spark):
    r = random.Random(1)
    data = [(i, r.choice([1.0, 2.0, 2.0, 2.0, r.random()]), None if i % 50 == 0 else i) for i in range(3000)]
    df = spark.createDataFrame(data, "key int, score double, other int").repartition(5)
    got = {x["key"]: x["rank"] for x in K.ranked_all(df, [-F.col("score"), F.col("key")]).collect()}
    assert got == {k: i for i, (k, _, _) in enumerate(sorted(data, key=lambda x: (-x[1], x[0])))}
    assert sorted(x["rank"] for x in K.ranked_all(df, [F.col("other"), F.col("key")]).collect()) == list(range(3000))
    assert K.ranked_all(df.limit(0), [F.col("key")]).count() == 0


def test_percentiles_by_both_rules(spark):
    rng = np.random.default_rng(5)
    groups = {g: sorted(rng.integers(0, 9, rng.integers(1, 40)).tolist()) for g in range(20)}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [(3, None)], "g int, v int")
    for q in (0.0, 0.5, 0.95, 1.0):
        for nearest in (False, True):
            got = {r["g"]: r["percentile"] for r in G.percentile_index(df, ["g"], "v", q, nearest).collect()}
            assert got == {g: vs[max(0, int(np.ceil(q * len(vs))) - 1) if nearest else min(len(vs) - 1, int(q * len(vs)))] for g, vs in groups.items()}


def test_state_digests_tell_tables_apart(spark):
    data = [(i, f"v{i % 7}") for i in range(300)]

    def digest(rows, parts, leaf=16):
        df = spark.createDataFrame(rows, "k int, v string").repartition(parts)
        return tuple(S.state_digest(df, "k", F.col("v"), leaf).first())

    assert digest(data, 1) == digest(data[::-1], 5) and digest(data, 1)[1] == 300
    others = [data[:-1], data[:-1] + [(299, "x")], data + [(299, "v5")], [(k + 1, v) for k, v in data], data[:-1] + [(299, None)]]
    assert len({digest(o, 2)[0] for o in [data, *others]}) == 6


def test_digests_gather_lists_only_after_rows_are_dealt_to_tasks(spark, monkeypatch):
    df = spark.range(3000).selectExpr("CAST(id AS INT) AS k", "concat('v', id % 7) AS v").coalesce(1)
    whole = tuple(S.state_digest(df, "k", F.col("v"), 16).first())
    monkeypatch.setattr(S, "TASK_ROWS", 500, raising=False)
    dealt = S.state_digest(df, "k", F.col("v"), 16)
    plan = dealt._jdf.queryExecution().executedPlan().toString().splitlines()
    gathers = [i for i, line in enumerate(plan) if "collect_list" in line]
    deals = [i for i, line in enumerate(plan) if "REPARTITION_BY_NUM" in line and ", 6)" in line]
    assert deals and max(gathers) < deals[0]
    assert tuple(dealt.first()) == whole


def test_contents_are_written_once(spark, tmp_path):
    path = str(tmp_path / "blobs")
    one = spark.createDataFrame([("a",), ("b",), ("a",)], "content string")
    assert files.write_once(one, "content", path).count() == 2
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "blobs").rglob("*.parquet")}
    assert sorted(r["length"] for r in files.write_once(spark.createDataFrame([("a",), ("ccc",)], "content string"), "content", path).collect()) == [3]
    assert files.write_once(one, "content", path).count() == 0
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())
    assert spark.read.parquet(path).select("digest").distinct().count() == 3


def test_pauses_follow_the_zone(spark):
    moments = ["2024-03-29 08:30:00", "2024-04-01 08:30:00", "2024-04-02 07:59:59", "2024-04-02 08:00:00", "2024-04-06 08:30:00", "2024-04-02 09:59:59", "2024-04-02 10:00:00"]
    df = spark.createDataFrame([(m,) for m in moments], "m string").withColumn("t", F.col("m").cast("timestamp"))
    until = L.pause_until(F.col("t"), "Europe/Berlin", [("09:00", "12:00")], range(5), ["2024-04-01"])
    got = {r["m"]: r["u"] for r in df.select("m", F.date_format(until, "yyyy-MM-dd HH:mm").alias("u")).collect()}
    # in winter 09:00 there is 08:00 here, in summer 07:00
    assert got == {moments[0]: "2024-03-29 11:00", moments[1]: None, moments[2]: "2024-04-02 10:00", moments[3]: "2024-04-02 10:00", moments[4]: None, moments[5]: "2024-04-02 10:00", moments[6]: None}


def test_receipts_that_disagree_raise(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "unit int, recipe string")
    assert D.consistent_receipt(df.where("unit = 2"), "unit", ["recipe"]).first()["recipe"] == "c"
    with pytest.raises(Exception, match="disagree for 1"):
        D.consistent_receipt(df, "unit", ["recipe"]).collect()


def test_snapshots_do_not_see_later_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    pinned = D.listed(spark, {"t": path})
    spark.range(5, 9).write.mode("append").parquet(path)
    assert D.snapshot(spark, pinned)["t"].count() == 5 and spark.read.parquet(path).count() == 9


def test_broken_receipt_chains(spark):
    rows = [("a", []), ("b", ["a"]), ("c", ["a", "b"]), ("d", ["x"]), ("e", ["b"]), ("f", ["b", "c"])]
    got = {r["receipt_id"]: r["reason"] for r in S.prefix_closure(spark.createDataFrame(rows, "receipt_id string, ancestors array<string>")).collect()}
    assert got == {"d": "missing_parent", "e": "broken_prefix", "f": "broken_prefix"}


# Fuzzy joins


def test_twins_match_all_pairs(spark):
    r = random.Random(6)
    families = ["Alva", "Berg", "Cruz", "Dahl", "Eide"]

    def works(n, doi):
        return [(i, i, "the long study of " + " ".join(r.choice(["wind", "wave", "rays", "dust"]) for _ in range(3)), [f"{r.choice('AB')}. {f}" for f in r.sample(families, r.randint(1, 3))], r.choice([0, None, 2001, 2002, 2005]), f"10.1/{i}" if doi ^ (i % 7 == 0) else "", "" if doi ^ (i % 7 == 0) else f"2001.{i}") for i in range(n)]

    a, b = works(50, True), works(60, False)
    cols = "string, authors array<string>, year int, doi string, arxiv_id string"
    got = {x["new_id"]: x["twin"] for x in M.twin_candidates(spark.createDataFrame(a, f"new_id int, pos int, title {cols}"), spark.createDataFrame(b, f"key int, pos int, title {cols}")).collect()}
    want = {}
    for x, y in itertools.product(a, b):
        names = [{n.split()[-1].lower() for n in w[3]} for w in (x, y)]
        opposite = bool(x[5]) != bool(y[5])
        near = not x[4] or not y[4] or abs(x[4] - y[4]) <= 2
        if opposite and near and len(names[0] & names[1]) / len(names[0] | names[1]) >= 0.7 and difflib.SequenceMatcher(None, x[2], y[2]).ratio() >= 0.85:
            want[x[0]] = min(want.get(x[0], 10**9), y[0])
    assert len(want) > 5 and got == want


def test_titles_resolve_as_by_all_pairs(spark):
    r = random.Random(8)
    titles = ["Observations of solar wind turbulence near the sun", "Observations of solar wind turbulence near the moon", "Short title", "A model of the outer heliosphere and its dust"]
    stubs = [(i, r.choice(titles), [f"A. {r.choice(['Berg', 'Cruz'])}", "B. Dahl"], r.choice([None, 2001, 2003])) for i in range(40)]
    found = [(r.randrange(40), r.choice(["10.1/a", "10.1/b", "10.1/A", " "]), r.choice(titles), r.choice([["A. Berg"], ["C. Cruz", "B. Dahl"], ["X. Other"]]), r.choice([None, 2001, 2002])) for _ in range(200)]
    cols = "title string, authors array<string>, year int"
    got = {x["stub_id"]: x["doi"] for x in M.title_to_doi(spark.createDataFrame(stubs, f"stub_id int, {cols}"), spark.createDataFrame(found, f"stub_id int, doi string, {cols}")).collect()}
    want = {}
    for i, title, authors, year in stubs:
        hits = set()
        for j, doi, other, names, when in found:
            if i != j or not doi.strip() or len(title) < 25:
                continue
            ratio = difflib.SequenceMatcher(None, title.lower(), other.lower()).ratio()
            a, b = set(title.lower().split()), set(other.lower().split())
            p, q = [n.split()[-1].lower() for n in authors], {n.split()[-1].lower() for n in names}
            if ratio >= (0.97 if year is None else 0.92) and len(a & b) / len(a | b) >= 0.9 and p[0] in q and len(set(p) & q) / len(set(p) | q) >= 0.5 and (year is None or when is not None and abs(year - when) <= 1):
                hits.add(doi.strip())
        if len({h.lower() for h in hits}) == 1:
            want[i] = min(hits)
    assert want and got == want


def test_venue_tiers_by_hand(spark):
    rows = [("Journal of Wind", "", "", 9), ("Journal of  Wind!", "10.9/x", "", 0), ("Jornal of Wind", "", "", 9), ("Blue Letters", "10.1/x", "", 9), ("Unknown Bulletin", "10.1/x", "", 0), ("Unknown Bulletin", "", "", 1), ("Unknown Bulletin", "", "2001.1", 1), ("", "", "", 0), (None, "10.1/y", "", 0)]
    df = spark.createDataFrame(rows, "venue string, doi string, arxiv_id string, citation_count int")
    got = C.venue_tiers(df, {"journal of wind": 1.5}, {"10.1/": 1.2}, "blue").collect()
    tiers = {(r["venue"], r["doi"], r["arxiv_id"]): r["tier"] for r in got}
    assert [tiers[v, d, a] for v, d, a, _ in rows] == [1.5, 1.5, 1.5, 0.5, 1.2, 0.5, 1.0, 1.0, 1.2]


# Sources


def test_links_match_a_plain_parser(spark):
    from html.parser import HTMLParser
    from urllib.parse import urljoin

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")

    class Anchors(HTMLParser):
        def __init__(self):
            super().__init__()
            self.found = []

        def handle_starttag(self, tag, attrs):
            if tag == "a" and dict(attrs).get("href"):
                self.found.append(dict(attrs)["href"])

    got = {}
    for r in page_links(pages).collect():
        got.setdefault(r["page_id"], set()).add(r.asDict().get("url") or r.asDict().get("href") or r.asDict().get("target"))
    seen = 0
    for r in pages.collect():
        parser = Anchors()
        parser.feed(r["html"] or "")
        want = {urljoin(r["url"], h.strip()).split("#")[0] for h in parser.found}
        mine = {u.split("#")[0] for u in got.get(r["page_id"], set()) if u}
        assert mine <= want
        seen += len(mine)
    assert seen > 50


ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><title>q</title>
<entry><id>http://arxiv.org/abs/2101.00001v2</id><published>2021-01-03T00:00:00Z</published><title>On
 winds</title><summary> A text. </summary><author><name>A. One</name></author><author><name>B. Two</name></author><arxiv:doi>10.1/X</arxiv:doi></entry>
<entry><id>http://arxiv.org/abs/2101.00002</id><title>No date</title><summary>s</summary></entry>
<entry><id>http://arxiv.org/abs/hep-ph/9901001</id><published>1999-01-03T00:00:00Z</published><title>Old</title><summary>t</summary><author><name>C. Three</name></author></entry></feed>"""


def test_answers_of_services_become_rows(spark):
    answers = [
        ("arxiv", 0, ATOM),
        ("ads", 1, json.dumps({"response": {"docs": [{"title": ["Main", "Other"], "author": ["One, A."], "year": "2004", "doi": ["10.1/A"], "identifier": ["arXiv:2101.00005", "x"], "bibcode": "2004B", "pub": "J", "citation_count": 7}, {"title": [], "year": "n.d."}]}})),
        ("semantic_scholar", 0, json.dumps({"data": [{"title": "S", "authors": [{"name": "A"}, {"name": ""}], "year": 2010, "citationCount": 3, "externalIds": {"DOI": "10.2/b", "ArXiv": "1001.0001"}, "paperId": "p", "venue": "", "publicationVenue": {"name": "V"}, "publicationTypes": ["Review"], "url": "u"}]})),
        ("openalex", 0, json.dumps({"results": [{"title": " "}, {"id": "https://openalex.org/W1", "title": "O", "authorships": [{"author": {"display_name": "A B"}}], "publication_year": 2015, "abstract_inverted_index": {"world": [1, 3], "hello": [0], "again": [2]}, "cited_by_count": 4, "doi": "https://doi.org/10.48550/arXiv.1501.00001", "type": "article", "primary_location": {"source": None}, "host_venue": {"display_name": "H"}}]})),
        ("inspire", 2, json.dumps({"hits": {"hits": [{"id": "9", "metadata": {"titles": [{"title": "I"}], "authors": [{"full_name": "One, A."}], "abstracts": [{"value": "abs"}], "dois": [{"value": "10.3/c"}], "arxiv_eprints": [{"value": "hep-th/9901002"}], "publication_info": [{"journal_title": "JHEP"}], "earliest_date": "1999-02", "citation_count": 1}}]}})),
        ("core", 0, json.dumps({"results": [{"id": 5, "title": " C ", "authors": [{"name": "Last, F."}], "yearPublished": 2018, "doi": "10.4/d", "arxivId": "bad", "publisher": "Pub", "downloadUrl": "", "sourceFulltextUrls": ["https://arxiv.org/pdf/1801.00002"], "citationCount": None}]})),
        ("core", 3, "broken {"), ("inspire", 3, None), ("arxiv", 3, "<html/>"),
    ]
    df = spark.createDataFrame(answers, "backend string, term_idx int, payload string")
    got = {(r["backend"], r["term_idx"], r["rank"]): r for r in payloads.parsed(df).collect()}
    assert sorted(got) == [("ads", 1, 0), ("ads", 1, 1), ("arxiv", 0, 0), ("arxiv", 0, 2), ("core", 0, 0), ("inspire", 2, 0), ("openalex", 0, 1), ("semantic_scholar", 0, 0)]
    a = got["arxiv", 0, 0]
    assert (a["title"], a["authors"], a["year"], a["abstract"], a["arxiv_id"], a["doi"]) == ("On winds", ["A. One", "B. Two"], 2021, "A text.", "2101.00001", "10.1/X")
    assert got["arxiv", 0, 2]["arxiv_id"] == "hep-ph/9901001"
    b = got["ads", 1, 0]
    assert (b["title"], b["year"], b["arxiv_id"], b["citation_count"], b["url"]) == ("Main", 2004, "2101.00005", 7, "https://ui.adsabs.harvard.edu/abs/2004B/abstract")
    assert got["ads", 1, 1]["year"] is None and got["ads", 1, 1]["title"] == ""
    c = got["semantic_scholar", 0, 0]
    assert (c["authors"], c["venue"], c["arxiv_id"], c["types"]) == (["A"], "V", "1001.0001", ["Review"])
    d = got["openalex", 0, 1]
    assert (d["abstract"], d["venue"], d["paper_id"], d["arxiv_id"], d["year"]) == ("hello world again world", "H", "W1", "1501.00001", 2015)
    e = got["inspire", 2, 0]
    assert (e["year"], e["venue"], e["arxiv_id"], e["paper_id"]) == (1999, "JHEP", "hep-th/9901002", "9")
    f = got["core", 0, 0]
    assert (f["title"], f["arxiv_id"], f["venue"], f["citation_count"], f["url"]) == ("C", "1801.00002", "Pub", 0, "https://arxiv.org/pdf/1801.00002")


def test_references_both_ways(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("a", "a"), (None, "c"), ("d", "a")], "citing string, cited string")
    papers = spark.createDataFrame([("a",), ("b",)], "key string")
    assert {tuple(r) for r in payloads.references_of(edges, papers).collect()} == {("a", "b"), ("b", "c")}
    assert {tuple(r) for r in payloads.references_of(edges, papers, True).collect()} == {("a", "d"), ("b", "a")}


def test_intervals_without_one_delta_are_those_of_the_others():
    from lectern.operators.evaluation import bca_interval, lows_without

    deltas = np.random.default_rng(4).normal(0.2, 1, 12)
    got = lows_without(deltas, range(12), 2000)
    want = [bca_interval(np.delete(deltas, k), 2000)[0] for k in range(12)]
    assert np.allclose(got, want, atol=1e-12)
    assert lows_without(np.array([0.5, -0.2]), [0, 1]).tolist() == [-0.2, 0.5]
    assert lows_without(np.array([0.5, 0.5, 0.5]), [2]).tolist() == [0.5]


def test_a_gain_must_survive_without_any_mover(spark):
    from lectern.operators.evaluation import mover_jackknife, movers_left_out

    def pairs(**gains):
        return spark.createDataFrame([(m, f"q{i}", 1.0, 1.0 + g) for m, own in gains.items() for i, g in enumerate(own)], "metric string, qid string, a double, b double")

    rows = pairs(fragile=[0.5, 0.5, -0.45], sound=[0.5, 0.4, 0.45, 0.0], falls=[-0.5, -0.4, -0.45], one=[0.5, 0.0], two=[0.5, 0.1], none=[0.0])
    got = {r["metric"]: (r["n"], r["n_movers"], r["survives"]) for r in mover_jackknife(rows, ["falls"], rounds=1000).collect()}
    assert got == {"fragile": (3, 3, False), "sound": (4, 3, True), "falls": (3, 3, True), "one": (2, 1, False), "two": (2, 2, True), "none": (1, 0, False)}
    each = {(r["metric"], r["dropped"]): r["survived"] for r in movers_left_out(rows, rounds=1000).collect()}
    assert each["fragile", "q0"] is False and each["fragile", "q2"] is True and ("one", "q0") not in each and each["falls", "q0"] is False


def test_requests_share_work_until_its_result_goes(spark):
    from lectern.operators.records import requests_joined

    rows = [(1, "a", 0, 8.0), (2, " a ", 8, 1.0), (3, "a", 16, 5.0), (4, "A", 16, 1.0), (5, "a", 18, 5.0), (6, "a  b", 0, None), (7, "a b", 0, 1.0), (8, "a  b\n", 10**6, 1.0), (9, " ", 0, 1.0), (10, None, 0, 1.0), (11, "a", 0, 8.0)]
    df = spark.createDataFrame(rows, "request_id long, query string, at long, seconds double").repartition(3)
    got = dict(sorted((r["request_id"], r["leader"]) for r in requests_joined(df, 10.0).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 6, 9: None, 10: None, 11: 1}
