"""Cleaning pipeline over `documents`: quality, repeated lines, near copies, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as
Parquet in the shared folder and hands the next stage the reread table. All but the last return
the columns of documents. SQL cannot express the classifier, the sampling or the packing, so
ORACLE_SQL is None and the stages are tested against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import unused, written
from lectern.llm.decontaminate import decontaminate
from lectern.llm.lines import dedup_lines
from lectern.llm.neardup import keep_one
from lectern.llm.packing import pack_documents
from lectern.llm.quality import classify, train

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, fitted on all labels, does not reject.

    A null or empty text scores the prior of the labels and goes or stays by it; repeated rows and rows
    with a null id are judged each. An empty table stays empty. Columns of any name pass through.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "_lectern_score")
    return classify(docs, model, score_col=score, keep=True).where(F.col(score) >= 0.5).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later occurrences of three-line windows; n_chars follows the text.

    No row goes: a text whose lines all stood elsewhere becomes empty, null stays null. Rows that
    repeat both id and text count as one. An empty table stays empty. Columns of any name pass through.
    """
    return dedup_lines(docs, count_col=None, chars_col="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest id.

    Null and empty texts are copies of each other, so one stays; of rows that share an id one stays;
    rows with a null id all stay. An empty table stays empty. Columns of any name pass through.
    """
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, repeated rows are judged each. An empty table of either
    kind takes nothing away. Columns of any name pass through.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in the training sequences.

    A null or empty text is one piece of the separator alone; repeated rows and rows with a null id
    are packed each. An empty table gives no piece. Only doc_id and text are read.
    """
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
