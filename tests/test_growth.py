"""Cases that only larger or odder tables bring: long keys, many copies, crowded groups."""

import duckdb
import pytest

from pyspark.sql import functions as F

from lectern.operators import matching as M
from lectern.plans import registry


def made(tmp_path, **tables):
    """A folder of standard tables, each from its SQL."""
    for name, sql in tables.items():
        duckdb.sql(sql).write_parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def same_as_sql(spark, folder, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    rel = con.sql(registry.ORACLE[name])
    columns = sorted(rel.columns)
    got = sorted(str([r[c] for c in columns]) for r in registry.QUERIES[name](spark, folder).collect())
    return got == sorted(str([x for _, x in sorted(zip(rel.columns, row, strict=True))]) for row in rel.fetchall())


def joined_rows(df):
    """The most rows that a join of the executed plan gave out."""
    df.collect()
    out, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            nodes.append(node.plan())
        if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
            out = max(out, node.metrics().apply("numOutputRows").value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_identities_of_six_digit_keys(spark, tmp_path):
    folder = made(tmp_path, customer="SELECT CAST(k AS BIGINT) AS c_custkey FROM (VALUES (1), (99997), (123457), (899997), (123456)) t(k)")
    assert same_as_sql(spark, folder, "identities", ["customer"])


def test_copies_of_titles_do_not_meet_in_pairs(spark):
    wanted = spark.createDataFrame([(k, "large ring of the north", "10.1/w" if k == 7 else "") for k in range(300)], "want_id int, title string, doi string")
    served = spark.createDataFrame([(k, "large ring of the north", "10.1/W " if k == 299 else "") for k in range(5, 300)] + [(2, "another thing", "10.1/w")], "key int, title string, doi string")
    out = M.lenient_match(wanted, served)
    assert {r["want_id"]: r["hit"] for r in out.collect()} == {k: 2 if k == 7 else 5 for k in range(300)}
    assert joined_rows(out) <= 600
    grouped = M.lenient_match(wanted.selectExpr("*", "CASE WHEN want_id < 200 THEN want_id % 2 END AS pool"), served.selectExpr("*", "key % 2 AS pool"), by="pool")
    assert {r["want_id"]: r["hit"] for r in grouped.collect()} == {k: None if k >= 200 else 5 if k % 2 else 6 for k in range(300)}


def test_matches_of_a_pool_are_gathered_once_a_key(spark):
    entries = spark.createDataFrame([(k, "One Title" if k % 2 else "", "10.1/a" if k % 3 else None) for k in range(200)], "entry int, title string, doi string")
    records = spark.createDataFrame([(f"r{k:03}", "one title!" if k % 2 else "other", "10.1/A" if k % 5 == 0 else "") for k in range(200)], "key string, title string, doi string")
    out = M.all_matches(entries, records, "entry")
    want = {k: [f"r{j:03}" for j in range(200) if k % 2 and j % 2 or k % 3 and j % 5 == 0] for k in range(200)}
    assert {r["entry"]: r["matches"] for r in out.collect()} == want
    assert joined_rows(out) <= 400


def test_identities_of_observations_are_shuffled_once(spark):
    from pyspark.sql import functions as F

    from lectern.operators import coverage as C

    own = ", ".join(f"'{x}' AS {x}" for x in (*C.VERSION, *C.EXECUTION))
    receipts = spark.sql(f"SELECT concat('q', id) AS receipt_id, concat('n', id) AS namespace, {own} FROM range(6)")
    outputs = spark.sql("SELECT concat('q', id) AS receipt_id, 0 AS pos, 'chunks' AS role, 's' AS store, 't' AS output_id, CASE WHEN id = 4 THEN 'other' ELSE concat('n', id) END AS namespace, 'h' AS sha256, 1 AS byte_length, 'present' AS verified, 'scan' AS method, array(0) AS counts FROM range(7)")
    seen = receipts.selectExpr("concat('o', receipt_id) AS observation_id", "*", "'chunks' AS role", "'s' AS store", "'t' AS output_id", "'present' AS state", "TIMESTAMP '2024-01-30 23:59:00' AS observed_at", "'h' AS sha256", "1 AS byte_length")
    seen = seen.withColumn("attempt_id", F.when(F.col("receipt_id") == "q2", F.lit("none")).otherwise(F.col("attempt_id"))).withColumn("unit_id", F.when(F.col("receipt_id") == "q3", F.lit(None)).otherwise(F.col("unit_id")))
    later = seen.withColumns({"observation_id": F.concat(F.lit("p"), "receipt_id"), "state": F.lit("missing"), "observed_at": F.expr("TIMESTAMP '2024-01-30 23:59:30'")})
    heads = spark.createDataFrame([(f"oq{k}",) for k in range(6)] + [("pq5",)], "observation_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = C.output_evidence(receipts, outputs, seen.union(later), F.expr("TIMESTAMP '2024-01-31 00:00:00'"), 300.0, heads)
        got = {r["receipt_id"]: r["evidence"]["chunks"]["reason"] for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {"q0": "fresh_exact_output", "q1": "fresh_exact_output", **{f"q{k}": "no_matching_observation" for k in (2, 3, 4)}, "q5": "collector_verified_absence"}
    assert plan.count("Exchange hashpartitioning(receipt_id") >= 2 and "Exchange hashpartitioning(unit_id" not in plan and "Exchange hashpartitioning(receipt_id#" in plan and ", attempt_id#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


@pytest.mark.parametrize("name", ["aggregates_of_generations", "evidence_of_units", "evidence_of_records", "outcomes_of_sections"])
def test_coverage_is_worked_out_in_parts(spark, monkeypatch, tmp_path, name):
    from lectern.operators import coverage as C
    from lectern.operators import lineage as L

    data, tables = "/root/testdata/sf0.001", ["orders", "lineitem", "nation"]
    some = made(tmp_path, **{t: f"SELECT * FROM '{data}/{t}.parquet'" + {"orders": " WHERE o_orderkey < 300", "lineitem": " WHERE l_orderkey < 300"}.get(t, "") for t in tables})
    written = []
    monkeypatch.setattr(C, "PART", 400)
    monkeypatch.setattr(C, "saved_in_parts", lambda part, parts, *a: written.append(parts) or L.saved_in_parts(part, parts, *a))
    assert same_as_sql(spark, some, name, tables)
    assert written and set(written) == {3}


def test_shuffles_of_a_written_table_go_with_it(spark):
    import glob

    from lectern.operators.lineage import dropped, in_part, saved_in_parts

    held = lambda: len(glob.glob("/tmp/blockmgr-*/*/shuffle_*.data"))
    rows = spark.range(4000).selectExpr("CASE WHEN id % 10 > 0 THEN id % 700 END AS k", "id")
    before, seen = held(), []
    def part(p):
        seen.append(held())
        return in_part(rows, "k", 3, p).repartition(3, "id").groupBy("k").agg(F.count("*").alias("n"))

    out = saved_in_parts(part, 3, "parts")
    assert {r["k"]: r["n"] for r in out.collect()} == {r["k"]: r["count"] for r in rows.groupBy("k").count().collect()}
    assert max(seen) <= before  # none of an earlier part
    dropped(out)
    assert not spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "true"


def test_nearest_rows_are_those_of_the_plain_expression(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from lectern.operators import graphs as G

    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (40, 5)).astype(np.float32).tolist()
    rows = [(k, base[k % 40]) for k in range(400)] + [(400, [1.0, None, 0.0, 0.0, 1.0]), (401, None), (402, [1.0, 2.0])]
    corpus = spark.createDataFrame(rows, "key long, vector array<float>").repartition(3)
    asked = corpus.where("key % 50 = 0 OR key = 402").selectExpr("key AS qid", "vector")
    out = G.vector_top_k(corpus, asked, 7)
    got = sorted((r["qid"], r["rank"], r["key"], r["distance"]) for r in out.collect())
    pairs = corpus.crossJoin(asked.withColumnRenamed("vector", "_q")).select("qid", "key", F.round(G.cosine_distance(F.col("vector"), F.col("_q")), 9).alias("distance"))
    want = G.ranked(pairs, ["qid"], [F.col("distance"), F.col("key")], most=7)
    assert got == sorted((r["qid"], r["rank"], r["key"], r["distance"]) for r in want.collect())
    fine = asked.where("size(vector) = 5 AND key <> 400" if "key" in asked.columns else "size(vector) = 5 AND qid <> 400").toArrow()
    batch = corpus.where("key < 400").coalesce(1).toArrow().combine_chunks().to_batches()[0]
    assert sum(b.num_rows for b in G.nearest_of_batches(fine, 7)(iter([batch]))) <= 14 * fine.num_rows


def test_repairs_need_no_row_for_each_selection(spark):
    from lectern.operators import records as R

    repairs = spark.range(200).selectExpr("id AS repair_id", "id % 10 AS publication_id", "CASE WHEN id % 3 > 0 THEN id % 4 END AS target_generation", "-id AS created_at")
    publications = spark.range(10).selectExpr("id AS publication_id", "id % 2 AS derivation_id")
    selections = spark.range(900).selectExpr("id % 3 AS derivation_id", "id % 4 AS generation_id")
    generations = spark.createDataFrame([(0, "active", 1, 1), (1, "active", 2, 1), (2, "retired", 1, 2), (3, "active", 2, 0)], "generation_id long, state string, manifest_revision int, source_manifest_revision int")
    out = R.pending_repairs(repairs, publications, selections, generations, 500)
    rows = repairs.join(publications, "publication_id").join(selections, "derivation_id").join(generations.where("state = 'active'").selectExpr("generation_id", "manifest_revision AS m"), "generation_id").join(generations.selectExpr("generation_id AS target_generation", "source_manifest_revision AS s"), "target_generation", "left").where("target_generation IS NULL OR s <> m")
    want = [r["repair_id"] for r in rows.orderBy("created_at", "repair_id").limit(500).select("repair_id").collect()]
    assert [r["repair_id"] for r in out.collect()] == want
    assert joined_rows(out) <= 900


def test_chunks_leave_a_task_a_few_rows_at_a_time(spark):
    import pyarrow as pa

    from lectern.functions import python as P

    texts = [None, "", "One here. Two there.\n\nThree."] + [f"Sentence {k}. " * (k % 9 + 1) for k in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for new, old in ((P.chunked(df, "text", 8, 2), P.chunker(8, 2)), (P.sectioned(df, "text", 8), P.sectioner(8))):
        want = df.select("doc_id", old("text").alias("c")).selectExpr("doc_id", "inline(c)")
        assert new.schema.simpleString() == want.schema.simpleString() and sorted(map(tuple, new.collect())) == sorted(map(tuple, want.collect()))
    sizes = []

    class Caught:
        schema = df.schema

        def mapInArrow(self, run, schema):
            sizes.extend(b.num_rows for b in run(iter([pa.record_batch({"doc_id": list(range(503)), "text": texts})])))

    P.chunked(Caught(), "text", 8, 2)
    assert len(sizes) == 8 and max(sizes) < 1000


def test_the_language_model_learns_from_every_piece(spark):
    from lectern.llm.lm import PIECE, SHARE, pieces

    rows = spark.sql("SELECT repeat('a', CAST(id * 700 AS INT)) AS text, id AS key FROM range(400)")
    want = sum(max(1, -(-k * 700 // PIECE)) for k in range(400))
    assert pieces(rows, SHARE).count() == want


def test_twins_of_a_crowded_surname_are_the_first_in_order(spark, monkeypatch):
    from difflib import SequenceMatcher

    import numpy as np

    rng = np.random.default_rng(5)
    words = "large small hot cold ring bolt plate nut".split()
    def work(k):
        return (k, k, f"A study of the {' '.join(rng.choice(words, 3))} and kind {k}", ["A. Bell", f"C. Fam{k % 3}", *(["D. Day"] if k % 7 == 0 else [])], int(2000 + k % 7))

    new = [(*work(k), "10.1/a", None) for k in range(90)]
    library = [(*work(k), None, "1") if k % 11 else (*work(k), "10.1/b", None) for k in range(140)]
    cols = "title string, authors array<string>, year int, doi string, arxiv_id string"
    written = []
    monkeypatch.setattr(M, "saved", lambda df, name, own=M.saved: written.append(own(df, name)) or written[-1])
    out = M.twin_candidates(spark.createDataFrame(new, f"new_id int, pos int, {cols}"), spark.createDataFrame(library, f"key int, pos int, {cols}"))

    def twin(x, y):
        p, q = ({n.split()[-1] for n in r[3]} for r in (x, y))
        return not y[5] and abs(x[4] - y[4]) <= 2 and len(p & q) / len(p | q) >= 0.7 and SequenceMatcher(None, x[2].lower(), y[2].lower()).ratio() >= 0.85

    want = {x[0]: hit for x in new if (hit := min((y[0] for y in library if twin(x, y)), default=None)) is not None}
    assert {r["new_id"]: r["twin"] for r in out.collect()} == want and len(want) > 20
    assert len(written) > 3  # the library, and rounds of open records


def test_what_leaving_out_holds_does_not_grow_with_the_deltas():
    import tracemalloc

    import numpy as np

    from lectern.operators.evaluation import bca_interval, lows_without

    deltas = np.random.default_rng(4).normal(0.2, 1, 40_000)
    tracemalloc.start()
    got = lows_without(deltas, range(300, 812), 60)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # 512 copies of the deltas take 164 MB
    assert np.allclose(got[[0, 7, 511]], [bca_interval(np.delete(deltas, k), 60)[0] for k in (300, 307, 811)], atol=1e-10)


def test_twins_meet_without_broadcasts(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(M, "saved", lambda df, name, own=M.saved: plans.append(df._jdf.queryExecution().executedPlan().toString()) or own(df, name))
    work = ["id AS pos", "concat('A study of the ring and kind ', id) AS title", "array(concat('C. Fam', id % 3)) AS authors", "2000 AS year"]
    new, library = spark.range(60).selectExpr("id AS new_id", *work, "'10.1/a' AS doi", "'' AS arxiv_id"), spark.range(80).selectExpr("id AS key", *work, "'' AS doi", "'1' AS arxiv_id")
    out = M.twin_candidates(new, library)
    assert {r["new_id"]: r["twin"] for r in out.collect()} == {k: k % 3 for k in range(60)}
    assert len(plans) >= 4 and not any("BroadcastExchange" in plan for plan in plans)


def test_one_pass_over_the_draws_decides_all_movers(spark, monkeypatch):
    import numpy as np

    from lectern.operators import evaluation as E

    rng, seen = np.random.default_rng(7), set()
    for k in range(30):
        n = 70 + 5 * k
        deltas = [rng.normal(0.18, 1, n), rng.integers(-3, 5, n) / 4, np.append(rng.normal(0.15, 1, n), 1e9 * (-1) ** k)][k % 3]
        want = E.lows_without(deltas, range(len(deltas)), 300, seed=k) > 0
        assert (E.gains_without(deltas, 300, seed=k) == want).all()
        seen |= set(want.tolist())
    assert seen == {True, False}
    drawn, own = [0], np.random.default_rng

    class Counted:
        def __init__(self, seed):
            self.rng = own(seed)

        def integers(self, low, high, size):
            drawn[0] += size[0] * size[1]
            return self.rng.integers(low, high, size)

    monkeypatch.setattr(np.random, "default_rng", Counted)
    assert E.gains_without(np.full(9000, 0.5), 20).all() and drawn[0] == 20 * 8999
    pairs = spark.range(9000).selectExpr("'m' AS metric", "id AS qid", "0.0D AS a", "CASE WHEN id % 9 = 0 THEN -1.0D ELSE 0.5D END AS b")
    out = E.movers_left_out(pairs, rounds=20)
    assert out.count() == 9000 and "explode" not in plan_of(out)  # no block of movers draws anew


def test_long_windows_lie_in_few_cells(spark):
    rows = [(k, 1000 * k % 7919, 1000 * k % 7919 + n) for k, n in enumerate([1, 599, 600, 601, 4800, 4801, 9600, 9601, 90_000, 1_000_000, 0, -5])]
    windows = spark.createDataFrame(rows, "w int, s long, e long")
    points = spark.createDataFrame([(p, 137 * p - 3000) for p in range(900)], "p int, at long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = M.point_in_interval(points, windows, "at", "s", "e", 600)
        assert {(r["p"], r["w"]) for r in out.collect()} == {(p, w) for p in range(900) for w, s, e in rows if s <= 137 * p - 3000 < e}
        plan = out._jdf.queryExecution().executedPlan()
        nodes, spread = [plan], 0
        while nodes:
            node = nodes.pop()
            if node.nodeName() == "AdaptiveSparkPlan":
                nodes.append(node.executedPlan())
                continue
            if "QueryStage" in node.nodeName():
                nodes.append(node.plan())
            if node.nodeName() == "Generate":
                spread += node.metrics().apply("numOutputRows").value()
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert 0 < spread <= 9 * len(rows)  # buckets of 600 would be 1,850 rows


def test_pairs_of_long_windows_are_stored_in_little_room(spark, tmp_path):
    windows = spark.range(400).selectExpr("id AS w", "id * 3 AS s", "1000000 + id AS e").repartition(1)
    points = spark.range(40_000).selectExpr("id AS p", "id * 25 AS at").repartition(3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        M.point_in_interval(points, windows, "at", "s", "e", 600).select("p", "w", "s").write.parquet(str(tmp_path / "pairs"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == sum(40_000 - -(-w * 3 // 25) for w in range(400))
    assert sum(x.stat().st_size for x in (tmp_path / "pairs").glob("*.parquet")) < 0.4 * 400 * 40_000


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_long_lists_are_ranked_by_ranges(spark, tmp_path):
    from lectern.operators import ranking as R
    from lectern.operators import retrieval as V
    from lectern.plans import ranking

    rows = spark.range(3000).selectExpr("CASE WHEN id % 10 < 9 THEN 'a' WHEN id % 20 = 9 THEN 'b' END AS g", "id * 7919 % 101 AS v", "id")
    got = {(r["g"], r["v"], r["id"]): r["rank"] for r in R.ranked_wide(rows, ["g"], [F.col("v").desc(), F.col("id")]).collect()}
    want = {}
    for g in ("a", "b", None):
        want |= {key: i for i, key in enumerate(sorted((k for k in got if k[0] == g), key=lambda k: (-k[1], k[2])))}
    assert len(got) == 3000 and got == want
    folder = made(tmp_path, orders="SELECT 'F' AS o_orderstatus, '1-URGENT' AS o_orderpriority, i AS o_custkey, i % 40 AS o_totalprice, i AS o_orderkey FROM range(100) t(i)")
    lists = ranking.lists(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))
    chunks = lists.selectExpr("qid", "list_idx", "rank", "key", "concat('p', key % 9) AS paper", "'canon' AS tier")
    served = V.fused_retrieval(chunks, spark.createDataFrame([("F", "strong", 2, 3)], "qid string, band string, sources int, facets int"), 2)
    assert served.count() == 18
    for df in (lists, served):
        windows = [line for line in plan_of(df).splitlines() if "Window [" in line and "row_number" in line]
        limits = plan_of(df).count("WindowGroupLimit")
        assert windows and sum("_part#" not in line for line in windows) == limits, plan_of(df)  # a whole group meets only where it is cut to its first rows


def test_served_and_gold_keys_meet_without_a_join(spark):
    from lectern.operators import evaluation as E

    served = spark.createDataFrame([(1, 0, "a"), (1, 4, "b"), (1, 2, "b"), (1, 0, None), (2, 0, "c"), (None, 0, "a")], "qid int, rank int, key string")
    gold = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, None), (3, "a"), (None, "a")], "qid int, key string")
    curve, rate = E.recall_curve(served, gold, [1, 3]), E.hallucinated(gold, served)
    assert {(r["qid"], r["cut"]): round(r["recall"], 6) for r in curve.collect()} == {(1, 1): round(1 / 3, 6), (1, 3): round(2 / 3, 6), (3, 1): 0, (3, 3): 0, (None, 1): 0, (None, 3): 0}
    assert {r["qid"]: round(r["rate"], 6) for r in rate.collect()} == {1: round(1 / 3, 6), 3: 1, None: 1}
    assert "Join" not in plan_of(curve) + plan_of(rate)


def test_commands_of_many_units_share_a_batch(spark):
    from lectern.operators import commands as C

    log = spark.range(4000).selectExpr("id AS operation_id", "CASE WHEN id % 40 > 0 THEN id % 40 END AS unit", "id AS seq", f"element_at(array({', '.join(map(repr, C.ACTIONS))}), CAST(id * 7919 % 101 % {len(C.ACTIONS)} + 1 AS INT)) AS action", "id % 3 AS token", "'p' AS payload")
    want = sorted(map(str, C.commands_reduced(log, 64).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = C.commands_reduced(log)
        assert len(want) == 4000 and sorted(map(str, out.collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert plan_of(out).count("FlatMapGroupsInPandas") == 1  # the tables of large units alone
