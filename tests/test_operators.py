import datetime
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions import python as P
from lectern.functions import text as T
from lectern.operators import evaluation as E
from lectern.operators import graphs as G
from lectern.operators import ledgers as L
from lectern.operators import matching as M
from lectern.operators import predicates as R
from lectern.operators import ranking as K
from lectern.operators import sync as S


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


# Ranking


def lists_of(spark, *lists):
    data = [("q", i, r, k) for i, keys in enumerate(lists) for r, k in enumerate(keys)]
    return spark.createDataFrame(data, "qid string, list_idx int, rank int, key string")


def fair(lists, cap):
    places, out = [0] * len(lists), []
    while len(out) < cap and any(p < len(x) for p, x in zip(places, lists)):
        for i, x in enumerate(lists):
            while places[i] < len(x) and x[places[i]] in out:
                places[i] += 1
            if places[i] < len(x) and len(out) < cap:
                out.append(x[places[i]])
    return out


def test_round_robin_skips_within_a_turn(spark):
    got = K.round_robin(lists_of(spark, "abc", "ad", "e"), 5).orderBy("pos").collect()
    assert [r["key"] for r in got] == list("adebc")


@pytest.mark.parametrize("seed", range(4))
def test_round_robin_cut_loses_nothing(spark, seed):
    rng = np.random.default_rng(seed)
    lists = [[str(x) for x in rng.permutation(30)[: rng.integers(1, 30)]] for _ in range(5)]
    for cap in (1, 3, 7, 40):
        got = K.round_robin(lists_of(spark, *lists), cap).orderBy("pos").collect()
        assert [r["key"] for r in got] == fair(lists, cap)


def test_rrf_ties_go_by_first_appearance(spark):
    got = K.rrf_representative(lists_of(spark, "ab", "ba", [""]).withColumn("item", F.concat("key", "list_idx")), ["item"], ["qid"]).orderBy("fused_rank").collect()
    assert [(r["key"], r["item"]) for r in got] == [("a", "a0"), ("b", "b0")]


def test_bm25_guards(spark):
    pool = spark.createDataFrame([("a", "solar wind"), ("b", None), ("c", "wind wind"), ("d", "東京")], "key string, text string")
    queries = spark.createDataFrame([(0, "solar"), (1, "東京"), (2, "")], "term_idx int, term string")
    assert [(r["term_idx"], r["key"]) for r in K.bm25(pool, queries).collect()] == [(0, "a")]
    assert K.bm25(pool.limit(0), queries).count() == 0


def test_named_cover_moves_one_witness(spark):
    df = spark.createDataFrame([("q", f"k{i}", i, 1 if i < 5 else 2, 0.9) for i in range(6)], "qid string, key string, rank int, mask int, score double")
    got = [r["key"] for r in K.named_cover(df, 2, 3).orderBy("rank").collect()]
    assert got[:3] == ["k0", "k1", "k5"]


def test_token_budget_keeps_the_first(spark):
    df = spark.createDataFrame([("q", 0, 99), ("q", 1, 1), ("r", 0, 4), ("r", 1, 6), ("r", 2, 1)], "qid string, rank int, cost int")
    assert sorted((r["qid"], r["rank"]) for r in K.token_budget(df, 10, ["qid"], F.col("cost")).collect()) == [("q", 0), ("r", 0), ("r", 1)]


# Text


@pytest.mark.parametrize("raw,doi", [("doi: 10.1234/ABC", "10.1234/abc"), ("https://dx.doi.org/10.1234/x, 10.1/y", "10.1234/x"), ("none", ""), (None, "")])
def test_canonical_doi(spark, raw, doi):
    assert one(spark, T.canonical_doi(F.lit(raw).cast("string"))) == doi


@pytest.mark.parametrize("raw,clean,ok", [("arXiv:0704.0001v3", "0704.0001", True), ("0703.0001", "0703.0001", False), ("hep-th/9913001", "hep-th/9913001", False), ("astro-ph/9912001v2", "astro-ph/9912001", True), ("2313.00001", "2313.00001", False), ("x", "x", False), ("https://arxiv.org/pdf/2401.12345.pdf", "2401.12345", True)])
def test_arxiv(spark, raw, clean, ok):
    assert (one(spark, T.normalize_arxiv(F.lit(raw))), one(spark, T.valid_arxiv(F.lit(raw)))) == (clean, ok)


@pytest.mark.parametrize("name,want", [("A. P. Rouillard", "rouillard"), ("Chiappetta, Federica", "chiappetta"), ("De Rosa, M. L.", "rosa"), ("", ""), (None, "")])
def test_surname(spark, name, want):
    assert one(spark, T.surname(F.lit(name).cast("string"))) == want


def test_canonical_json_orders_keys(spark):
    m = F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("2"))
    assert one(spark, T.canonical_json(m)) == '{"a":"2","b":"1"}'


def test_sentences_and_chunks():
    text = "Dr. A. Smith et al. saw 3.5 units. It was fine! Was it?\n\nNew part (see Fig. 2). End"
    assert P.sentences(text) == ["Dr. A. Smith et al. saw 3.5 units.", "It was fine!", "Was it?", "New part (see Fig. 2).", "End"]
    long = " ".join(f"Sentence number {i} stands here." for i in range(200))
    chunks = P.pack_sentences(long, 100, 20)
    assert all(c["tokens"] <= 100 and c["content"].endswith(".") for c in chunks)
    assert [c["chunk_order_index"] for c in chunks] == list(range(len(chunks)))
    assert all(a["content"].split(". ")[-1] in b["content"] for a, b in itertools.pairwise(chunks))
    assert P.pack_sentences("", 10) == [] and P.pack_sentences("x" * 100, 10, 2)[0]["tokens"] == 10
    assert "".join(c["content"] for c in P.pack_sentences("y" * 95, 10, 0)) == "y" * 95


def test_closing_sections_go_and_bodies_stay():
    body = "Intro text. " * 40
    text = f"{body}\n\n## Acknowledgements\nThanks.\n\n## Funding\nMoney.\n\n## Appendix\nKept."
    assert P.without_closing(text) == f"{body.rstrip()}\n\n## Appendix\nKept."
    table = f"{body}\n\n## Funding\n| a | b |\n| 1 | 2 |"
    assert P.without_closing(table) == table
    assert P.without_closing("# Funding\nshort") == "# Funding\nshort"
    assert P.without_references(f"{body}\n# References\n[1] x") == body.rstrip()
    assert P.without_references(f"# References\n{body}") == f"# References\n{body}"


def test_sequence_ratio(spark):
    df = spark.createDataFrame([("abcd", "bcde"), ("", "a"), (None, "a")], "a string, b string")
    assert [r["r"] for r in df.select(P.sequence_ratio("a", "b").alias("r")).collect()] == [0.75, 0.0, 0.0]


def test_author_forms(spark):
    df = spark.createDataFrame([("Müller, J.A.",), (None,), ("Jean de la Tour",)], "n string")
    got = df.select(P.canonical_author("n").alias("a"), P.slug_surname("n").alias("s"), P.unicode_surface_key("n").alias("k")).collect()
    assert [tuple(r) for r in got] == [("J. A. Müller", "muller", "müller,j.a."), ("", "", ""), ("Jean de la Tour", "tour", "jeandelatour")]


# Matching


def test_alias_cycles_have_no_root(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s")], "key string, target string")
    got = {r["key"]: (r["root"], r["is_cycle"]) for r in M.alias_chase(df).collect()}
    assert got == {"a": ("c", False), "b": ("c", False), "x": (None, True), "y": (None, True), "z": (None, True), "s": (None, True)}


def test_ambiguous_titles_resolve_to_nothing(spark):
    title = "A sufficiently long title about things"
    stub = spark.createDataFrame([(1, title, ["A. Bell"], 2001), (2, title, ["A. Bell"], None), (3, "Short", ["A. Bell"], 2001)], "stub_id int, title string, authors array<string>, year int")
    found = spark.createDataFrame([(1, "10.1/A", title + "!", ["Bell, A."], 2002), (1, "10.1/a", title, ["A. Bell"], 2001), (2, "10.1/x", title, ["A. Bell"], 1990), (2, "10.1/y", title, ["A. Bell"], 1990), (3, "10.1/z", "Short", ["A. Bell"], 2001)], "stub_id int, doi string, title string, authors array<string>, year int")
    assert [(r["stub_id"], r["doi"]) for r in M.title_to_doi(stub, found).collect()] == [(1, "10.1/A")]


def test_lenient_matches_lose_nothing(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(12)]
    served = [(k, " ".join(rng.choice(words, rng.integers(2, 12))), f"10.1/{k}" if k % 9 == 0 else "") for k in range(150)]
    wanted = [(k, " ".join(rng.choice(words, rng.integers(2, 8))), f"10.1/{k}" if k % 5 == 0 else "") for k in range(60)]
    wanted += [(100 + k, " ".join(served[k][1].split()[1:-1]), "") for k in range(40)]

    def hit(x, y):
        p, q = x[1].split(), y[1].split()
        short, long = sorted((p, q), key=len)
        return x[2] and x[2] == y[2] or len(short) >= 4 and " ".join(short) in " ".join(long) or p and q and len(set(p) & set(q)) / len(set(p) | set(q)) >= 0.8

    a, b = spark.createDataFrame(wanted, "want_id long, title string, doi string"), spark.createDataFrame(served, "key long, title string, doi string")
    got = {r["want_id"]: r["hit"] for r in M.lenient_match(a, b).collect()}
    assert got == {x[0]: min((y[0] for y in served if hit(x, y)), default=None) for x in wanted}


def test_twins_need_opposite_identifiers(spark):
    schema = "title string, authors array<string>, year int, doi string, arxiv_id string"
    new = spark.createDataFrame([(1, "The Solar Wind", ["A. Bell", "C. Day"], 2003, "10.1/a", ""), (2, "The Solar Wind", ["A. Bell"], 2003, "10.1/b", "2001.00001")], "new_id int, " + schema)
    lib = spark.createDataFrame([("p", 2, "The solar wind.", ["Anne Bell", "Day"], 2001, "", "2001.00001"), ("o", 1, "The solar wind", ["A. Bell", "C. Day"], 1999, "", "1"), ("d", 0, "The solar wind", ["A. Bell", "C. Day"], 2003, "10.1/c", "")], "key string, pos int, " + schema)
    assert rows(M.twin_candidates(new, lib)) == [(1, "p")]


def test_given_names_match_by_initials(spark):
    df = spark.createDataFrame([(["Bell, Anne", "Bell, Carl"], ["C. Bell", "A. Bell"]), (["Bell, Anne", "Bell, Anton"], ["A. Bell", "C. Bell"]), (["Bell, Anne"], ["Belle, Anne"])], "a array<string>, b array<string>")
    assert [r["x"] for r in df.select(M.same_authors("a", "b").alias("x")).collect()] == [True, False, False]


# Predicates


def test_three_valued_types_and_garbage_order(spark):
    df = spark.createDataFrame([(["Article", "dataset"],), (["article"],), (["x"],), (None,)], "t array<string>")
    assert [r["x"] for r in df.select(R.is_paper(F.col("t")).alias("x")).collect()] == [False, True, None, None]
    with pytest.raises(ValueError):
        R.retry_filter(df, "other")


def test_unknown_policy_denies(spark):
    grant = F.struct(F.lit("k").alias("key"), F.lit(1).alias("revision"), F.array(F.lit("a")).alias("reasons"))
    allow = [R.policy_allows(F.lit(p).cast("string"), F.array(*map(F.lit, r)).cast("array<string>"), grant, F.lit("k"), F.lit(v)) for p, r, v in (("CLEAR", [], 0), ("CLEAR", ["a"], 1), ("OVERRIDE", ["a"], 1), ("OVERRIDE", ["a", "b"], 1), ("OVERRIDE", ["a"], 2), (None, [], 1))]
    assert [one(spark, a) for a in allow] == [True, False, True, False, False, False]


# Sync and states


def test_gap_in_the_journal_raises(spark):
    df = spark.createDataFrame([(1,), (2,), (4,)], "sequence long")
    assert S.change_delta(df, 4).count() == 0 and S.change_delta(df.where("sequence < 3"), 0).count() == 2
    with pytest.raises(Exception, match="gap"):
        S.change_delta(df, 0).collect()


def test_attempts_follow_the_machine(spark):
    steps = [("processing", "f1"), ("error", None), ("error", "f2"), ("processing", "f2"), ("error", None), ("error", None), ("processing", "f3"), ("error", None), ("done", None), ("error", None)]
    df = spark.createDataFrame([("k", i, s, f) for i, (s, f) in enumerate(steps)], "key string, seq int, status string, fingerprint string")
    got = L.attempt_machine(df).orderBy("seq").collect()
    assert [r["attempts"] for r in got] == [0, 1, 2, 2, 3, 4, 0, 1, 0, 1]
    assert [r["status"] for r in got][4:6] == ["error_parked"] * 2


def test_window_border_is_open(spark):
    at = [0.0, 10.0, 10.0, 20.0]
    df = spark.createDataFrame([(i, "c", datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=x)) for i, x in enumerate(at)], "id int, client string, ts timestamp")
    assert [(r["id"], r["in_window"]) for r in L.window_violations(df, "client", "ts", 1, 10.0, "id").collect()] == [(2, 2)]


def breaker_events(n=200):
    rng = np.random.default_rng(3)
    return [(int(k), i, float(i * 10), bool(b)) for i, (k, b) in enumerate(zip(rng.integers(0, 3, n), rng.random(n) < 0.6))]


def test_breaker_opens_probes_and_closes(spark):
    seq = [(0, True), (1, True), (2, True), (3, False), (13, False), (14, True)]
    df = spark.createDataFrame([("k", i, float(t), b) for i, (t, b) in enumerate(seq)], "key string, seq long, at double, failed boolean")
    got = L.sliding_breaker(df, "key", "at", "failed", 3, 100.0, 10.0).orderBy("seq").collect()
    assert [r["state"] for r in got] == ["CLOSED", "CLOSED", "OPEN", "OPEN", "CLOSED", "CLOSED"]


def test_budget_fold_merge_resets(spark):
    e = [("reserve", 150.0, 0), ("reserve", 100.0, 0), ("complete", 50.0, 0), ("merge", 0.0, 70), ("reserve", 130.0, 0), ("fence", 0.0, 0), ("reserve", 1.0, 0)]
    df = spark.createDataFrame([("a", i, k, x, float(t)) for i, (k, x, t) in enumerate(e)], "account string, seq int, kind string, amount double, total double")
    assert rows(L.budget_fold(df)) == [("a", 130.0, 70.0, 0, True, 2)]


def test_claims_move_by_legal_steps(spark):
    df = spark.createDataFrame([("a", 0, "dispatch"), ("a", 1, "expire"), ("a", 2, "complete"), ("b", 0, "complete"), ("b", 1, "release")], "key string, seq int, event string")
    assert sorted(rows(L.claim_phase(df))) == [("a", "quarantined"), ("b", "released")]


def test_layer_examples(spark):
    def visible(layers, graves):
        r = spark.createDataFrame([(w, "x", w) for w in layers], "workspace string, id string, payload string")
        g = spark.createDataFrame([(w, "vector", "x") for w in graves], "namespace string, role string, output_id string")
        return [x["payload"] for x in G.visible_rows(r, g, ["base", "d1", "d2"], "vector").collect()]

    assert visible(["base"], ["d1"]) == [] and visible(["base", "d1"], ["d1"]) == ["d1"] and visible(["base", "d1", "d2"], ["d1"]) == ["d2"] and visible(["other"], []) == []


def test_scrub_fills_up_only_where_ghosts_were(spark):
    df = spark.createDataFrame([(1, ["a", "g", "a", "b"], ["c", "g", "d", "e"]), (2, ["a"], ["c"])], "id int, ids array<string>, tracked array<string>")
    valid = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    got = {r["id"]: (r["ids"], r["n_ghosts"]) for r in S.scrub_references(df, "ids", valid, "tracked", 4).collect()}
    assert got == {1: (["a", "b", "c", "d"], 1), 2: (["a"], 0)}


def test_citation_keys_go_past_z(spark):
    df = spark.createDataFrame([(i, "b") for i in range(30)], "pos int, base string")
    taken = spark.createDataFrame([("b", "b")], "key string, base string")
    got = [r["key"] for r in S.citation_keys(df, F.col("base"), taken).orderBy("pos").collect()]
    assert got[0] == "ba" and got[25] == "bz" and got[26:28] == ["b_1", "b_2"]


# Evaluation


def test_permutation_p_matches_enumeration():
    rng = np.random.default_rng(1)
    d = rng.standard_normal(9)
    want = np.mean([abs(np.mean(d * s)) >= abs(d.mean()) - 1e-12 for s in itertools.product((1, -1), repeat=9)])
    assert E.sign_flip_p(d) == pytest.approx(want)
    assert E.sign_flip_p(np.zeros(5)) == 1.0 and 0 < E.sign_flip_p(rng.standard_normal(40) + 2) < 0.01


def test_bca_interval():
    rng = np.random.default_rng(2)
    d = rng.normal(0.5, 1, 60)
    low, high = E.bca_interval(d)
    assert low < d.mean() < high and E.bca_interval(d) == (low, high)
    assert E.bca_interval(np.full(4, 0.3)) == (pytest.approx(0.3), pytest.approx(0.3))


def test_lower_is_better_turns_the_sign(spark):
    df = spark.createDataFrame([("m", i, 1.0 + i / 100, 0.5 + i / 50) for i in range(12)], "metric string, qid int, a double, b double")
    got = E.compare_metrics(df, ["m"], rounds=500).first()
    assert got["improved"] and got["ci_low"] <= got["delta"] <= got["ci_high"] < 0


def test_missing_gate_input_fails(spark):
    v = spark.createDataFrame([("m", 1, 0.9), ("m", 2, None)], "metric string, qid long, value double")
    rules = spark.createDataFrame([("m", 0.5, None), ("n", None, 1.0)], "metric string, low double, high double")
    want = spark.createDataFrame([(1,), (2,)], "qid long")
    assert sorted(rows(E.gates(v, rules, want))) == [("m", False, "missing"), ("n", False, "missing")]


# Streams


def test_streams_agree_with_their_batch_twins(spark, tmp_path):
    from lectern.streaming import operators as O

    schema = "key long, seq long, at double, failed boolean"
    df = spark.createDataFrame(breaker_events(), schema)
    for part in range(4):
        df.where(f"seq >= {part * 50} AND seq < {part * 50 + 50}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in" / "*"))
    q = O.breaker(stream, "key", 3, 100.0, 50.0).writeStream.format("memory").queryName("breaker_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(rows(spark.table("breaker_out").select("key", "seq", "state"))) == sorted(rows(L.sliding_breaker(df, "key", "at", "failed", 3, 100.0, 50.0)))

    q = stream.writeStream.foreachBatch(O.upsert_latest(spark, str(tmp_path / "out"), "key", "seq")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    newest = spark.read.parquet(str(tmp_path / "out" / f"v{q.lastProgress['batchId']}"))
    assert sorted(rows(newest.select("key", "seq"))) == sorted(rows(df.groupBy("key").agg(F.max("seq"))))


# Sources


def test_sources(spark, tmp_path):
    from lectern.sources import files as X
    from lectern.sources.html import parse

    (tmp_path / "i.json").write_text('{"version": 2, "papers": {"a": {"title": "T", "more": 1}, "b": {}}}')
    assert sorted(rows(X.read_index(spark, str(tmp_path / "i.json"), "title STRING, year INT")), key=str) == [(2, "a", "T", None), (2, "b", None, None)]
    (tmp_path / "x.jsonl").write_text('# note\n{"qid": "a", "n": 1}\n\n  # more\n{"qid": "b"}\n')
    assert sorted(rows(X.read_jsonl(spark, str(tmp_path / "x.jsonl"), "qid STRING, n INT")), key=str) == [("a", 1), ("b", None)]
    (tmp_path / "k.txt").write_text("a # x\n\n#\nb\na\n")
    assert sorted(rows(X.read_keys(spark, str(tmp_path / "k.txt")))) == [("a",), ("b",)]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "q.1.c2.seed3.json").write_text('{"ims": 70}')
    assert rows(X.read_judgements(spark, str(tmp_path / "j" / "*.json"), "ims INT").select("qid", "chunk", "seed", "ims")) == [("q.1", "c2", 3, 70)]
    (tmp_path / "t").mkdir()
    for n, c in (("a.md", "m"), ("a.txt", "t"), ("b.txt", "u"), ("c.pdf", "%PDF")):
        (tmp_path / "t" / n).write_text(c)
    assert sorted(rows(X.read_texts(spark, str(tmp_path / "t")))) == [("a", "m", "md"), ("b", "u", "txt")]
    assert sorted(r["is_pdf"] for r in X.pdf_magic(spark, str(tmp_path / "t")).collect()) == [False, False, False, True]
    blobs = spark.createDataFrame([("x",), ("y",), ("x",)], "c string")
    assert X.write_once(blobs, "c", str(tmp_path / "b")).count() == 2 and X.write_once(blobs, "c", str(tmp_path / "b")).count() == 0
    df = spark.createDataFrame([('{"a":1,"a":2}',), ('{"a":1}',)], "j string")
    assert [r["x"] for r in df.select(X.strict_json(F.col("j")).isNull().alias("x")).collect()] == [True, False]
    lib = spark.createDataFrame([("k", "T & U", ["A", "B"], 2001, "V", None, True), ("l", "W", ["C"], None, "", "10.1/x", None)], "key string, title string, authors array<string>, year int, venue string, doi string, quarantine boolean")
    want = spark.createDataFrame([(0, "zz"), (1, "k"), (2, "aa")], "pos int, key string")
    assert rows(X.export_bibtex(lib, str(tmp_path / "o"), want)) == [("zz",), ("aa",)]
    assert "T \\& U" in "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "o")).collect())
    page = parse("https://a.example/x/", '<html lang=en><meta name="citation_pdf_url" content="/p.pdf"><title> T </title><a href="y">t <b>u</b></a><a>n</a>')
    assert page["pdf_url"] == "https://a.example/p.pdf" and page["links"] == [{"href": "https://a.example/x/y", "text": "t u"}] and page["title"] == "T"
    assert parse(None, None)["links"] == [] and isinstance(pd.DataFrame([page]), pd.DataFrame)


# Catalog


def test_identities_labels_and_items(spark):
    from lectern.operators import catalog as C

    def cands(*c):
        return F.array(*[F.struct(F.lit(r).alias("rung"), F.lit(k).alias("key")) for r, k in c])

    assert tuple(one(spark, C.canonical_identity(cands((2, "b"), (1, "z"), (1, "y")), F.struct(F.lit(2).alias("rung"), F.lit("a").alias("key"))))) == (1, "y")
    assert tuple(one(spark, C.canonical_identity(cands((1, "y")), F.struct(F.lit(1).alias("rung"), F.lit("z").alias("key"))))) == (1, "z")
    assert tuple(one(spark, C.serving_key(F.lit("The Sun!"), F.array(F.lit("Bell, A.")), F.lit(2001)))) == ("sun", "bell", 2001)
    verdicts = [one(spark, C.record_verdict(F.lit("Solar wind heating"), F.array(F.lit("A. Bell")), F.lit(x))) for x in ("SOLAR WIND by Bell", "solar wind by none", "rain by Bell")]
    assert verdicts == ["MATCH", "MISMATCH", "MISMATCH"]
    df = spark.createDataFrame([('[{"idx": 1, "score": 2}, {"idx": "x"}]',), ('bad {"idx": 0, "score": "inf"} {"idx"',), (None,)], "r string")
    got = [[tuple(x) for x in r["x"]] for r in df.select(C.judged_items("r").alias("x")).collect()]
    assert got == [[(1, 1.0)], [(0, 0.0)], []]
    text = spark.createDataFrame([("Title\nAbstract: We see\nthings.\n1. Introduction\nMore",), ("none",), (None,)], "t string")
    assert [r["x"] for r in text.select(C.labelled_abstract("t").alias("x")).collect()] == ["We see things.", None, None]
