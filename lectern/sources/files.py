"""Readers and writers for JSON indexes, JSONL, key files, judge files, texts, BibTeX and content-addressed blobs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import bibtex_escape


def read_index(spark: SparkSession, path: str, record: str) -> DataFrame:
    """A JSON document {version, papers: {key: record}} as rows; fields outside the record schema are dropped, missing ones null."""
    papers = spark.read.schema(f"version INT, papers MAP<STRING, STRUCT<{record}>>").json(path, multiLine=True)
    return papers.select("version", F.explode("papers").alias("key", "_r")).select("version", "key", "_r.*")


def strict_json(text: Column) -> Column:
    """The text as a variant; null if it is malformed or repeats an object key."""
    return F.try_parse_json(text)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines without blank lines and lines that start with #."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return lines.select(F.from_json("value", schema).alias("_r")).select("_r.*")


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """One key a line, comments after #, blanks passed over, each key once."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("key")).where("key <> ''").distinct()


def read_judgements(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Files <qid>.<chunk>.seed<k>.json: their records with qid, chunk and seed from the names."""
    rows = spark.read.schema(schema).json(pattern, multiLine=True).withColumn("_f", F.col("_metadata.file_name"))
    name = r"^(.*)\.([^.]*)\.seed([0-9]+)\.json$"
    return rows.withColumns({"qid": F.regexp_extract("_f", name, 1), "chunk": F.regexp_extract("_f", name, 2), "seed": F.regexp_extract("_f", name, 3).try_cast("int")}).where("qid <> ''").drop("_f")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(key, text, kind): whole .md and .txt files under a folder, Markdown preferred."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "*.{md,txt}").option("recursiveFileLookup", True).text(folder)
    named = rows.select(F.col("value").alias("text"), F.regexp_extract("_metadata.file_name", r"^(.*)\.(md|txt)$", 1).alias("key"), F.regexp_extract("_metadata.file_name", r"\.(md|txt)$", 1).alias("kind"))
    return named.groupBy("key").agg(F.min_by(F.struct("text", "kind"), F.col("kind")).alias("_r")).select("key", "_r.*")


def pdf_magic(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, is_pdf) of binary files, by their first bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"))


def bibtex(rows: DataFrame) -> DataFrame:
    """One BibTeX entry a row in column value."""
    def field(name: str, value: Column) -> Column:
        return F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(F.lit(f"  {name} = {{"), bibtex_escape(value.cast("string")), F.lit("}")))

    fields = F.concat_ws(",\n", field("title", F.col("title")), field("author", F.array_join("authors", " and ")), field("year", F.col("year")), field("journal", F.col("venue")), field("doi", F.col("doi")))
    return rows.select(F.concat(F.lit("@article{"), "key", F.lit(",\n"), fields, F.lit("\n}\n")).alias("value"))


def export_bibtex(library: DataFrame, path: str, keys: DataFrame | None = None) -> DataFrame:
    """Write entries, of all rows not quarantined or of the keys asked for, and return the keys that are missing in request order.

    keys: (pos, key).
    """
    rows = library.where(~F.coalesce("quarantine", F.lit(False))) if keys is None else library.join(keys.select("key").distinct(), "key", "left_semi")
    bibtex(rows).write.mode("overwrite").text(path)
    if keys is None:
        return library.sparkSession.createDataFrame([], T.StructType([T.StructField("key", T.StringType())]))
    return keys.join(library.select("key"), "key", "left_anti").orderBy("pos").select("key")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_once(blobs: DataFrame, content: str, path: str) -> DataFrame:
    """Store contents under their sha256, those not there yet; returns (digest, length) of the new ones.

    Each call writes a folder of its own and refuses one that is there; nothing written is touched
    again. Two calls at once may both store a content, under one digest and alike.
    """
    spark = blobs.sparkSession
    new = blobs.select(F.sha2(F.col(content).cast("binary"), 256).alias("digest"), F.col(content).alias("content")).groupBy("digest").agg(F.first("content").alias("content"))
    try:
        new = new.join(spark.read.parquet(path).select("digest"), "digest", "left_anti")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    target = f"{path}/batch={uuid.uuid4().hex}"
    new.withColumn("length", F.octet_length("content")).write.mode("error").parquet(target)
    return spark.read.schema("digest string, length int").parquet(target)


def normalise_hits(hits: DataFrame) -> DataFrame:
    """Backend rows: identifiers cleaned, year only if all digits, a flag for reviews."""
    from lectern.functions.text import canonical_doi, normalize_arxiv

    year = F.when(F.col("year").cast("string").rlike("^[0-9]{4}$"), F.col("year").cast("string").try_cast("int"))
    return hits.withColumns({"doi": canonical_doi(F.col("doi")), "arxiv_id": normalize_arxiv(F.col("arxiv_id")), "year": year, "is_review": F.lower("title").rlike(r"\breview\b") | F.coalesce("is_review", F.lit(False))})


def ranked_page(rows: DataFrame, key: str, after: str | None, n: int) -> DataFrame:
    """Keyset paging: the next n rows by key."""
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(n)
