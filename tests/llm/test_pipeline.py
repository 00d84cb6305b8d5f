from collections import Counter

import corpus_pipeline
from lectern.llm.decontaminate import leaks
from lectern.llm.neardup import near_duplicates

SF = "/root/testdata/sf0.01"


def test_stages_one_after_another(spark):
    from lectern.llm.common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), name)
        if name != "packing":
            assert out.columns == columns
            kept[name] = {r["doc_id"] for r in out.select("doc_id").collect()}
            docs = out
        else:
            packed = out
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    every = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    gone = every - kept["quality"]
    assert sum(labels.get(i) == 1 for i in gone) <= 0.02 * sum(v == 1 for v in labels.values())
    assert sum(labels.get(i) == 0 for i in gone) >= 0.8 * sum(v == 0 for i, v in labels.items() if i in every)
    assert kept["line_dedup"] == kept["quality"]
    assert max(Counter(r["class_id"] for r in near_duplicates(docs).collect()).values()) == 1
    assert leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    assert docs.where("n_chars <> length(text)").count() == 0
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept["decontamination"]


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls, repeats, copies and clashing columns through run(), then empty tables."""
    from pyspark.sql import functions as F

    extra = ["_lectern_score", "_lectern_id", "_LECTERN_N", "key", "gone", "a.b", "class_id"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    top = docs.agg(F.max("doc_id")).first()[0] + 1000
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi").orderBy(F.length("text").desc()).limit(1)
    odd = [good.withColumn("doc_id", F.lit(top).cast("long")), good, good.withColumn("doc_id", F.lit(None).cast("long"))]
    odd += [good.withColumns({"doc_id": F.lit(top + k).cast("long"), "text": F.lit(t).cast("string")}) for k, t in ((1, None), (2, ""), (3, None))]
    rows = docs
    for o in odd:
        rows = rows.unionByName(o.select(docs.columns))
    rows = rows.select("*", *[F.lit(f"kept {c}").alias(c) for c in extra])
    for name, df in (("documents", rows), ("labels", labels), ("benchmark", spark.read.parquet(f"{SF}/benchmark.parquet"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    sf, now, kept = str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    from lectern.llm.common import written

    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, sf), name)
        assert now.columns == rows.columns
        assert now.where(" OR ".join(f"`{c}` <> 'kept {c}' OR `{c}` IS NULL" for c in extra)).count() == 0
        kept[name] = [(r["doc_id"], r["text"]) for r in now.select("doc_id", "text").collect()]
    left = Counter(i for i, _ in kept["near_duplicates"])
    assert max(n for i, n in left.items() if i is not None) == 1
    assert left[top] + sum(i == top for i, _ in kept["near_duplicates"]) <= 2 and left[None] == 1
    assert sum(not t for i, t in kept["near_duplicates"] if i is not None) <= 1
    packed = corpus_pipeline.run(spark, sf).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(i for i, _ in kept["decontamination"])
    ends = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0) and 0 < r["length"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048
    for name, df in (("documents", rows), ("labels", labels), ("benchmark", spark.read.parquet(f"{SF}/benchmark.parquet"))):
        df.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
