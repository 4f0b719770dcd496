"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the
columns of `documents`, the last one pieces of packed sequences. run() applies them in order, each
stage's rows written and read again in between.

Every stage carries whole rows, so rows that repeat a doc_id are judged one by one and rows without a
doc_id stay like any other (the last one's pieces have none either). Null and empty texts have no
language and go in the first stage. Other columns, whatever their names, pass unchanged up to the last
stage, which drops them. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import decontaminate, exact_dedup, language, packing, simhash
from lexweave.llm.common import crc_fold, written
from lexweave.llm.queries import tokenizer_path


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go. The model learns from three of four labelled
    documents; a document's own label doesn't decide."""
    model = language.learn(docs.where(crc_fold("doc_id", 4) != 2))
    told = language.identify(docs, model, whole=True)
    return told.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= 0.5)).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the longest stays, then the one with the smallest
    doc_id, then one of those that repeat it."""
    return exact_dedup.one_of_each(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, about 0.8 or more of whose five-word shingles are the same, the document with the
    smallest doc_id stays."""
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), whole=True)
    return found.where(F.size("items") == 0).select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash", near_stage),
    ("decontaminate", decontamination_stage),
    ("packing", packing_stage),
]

#: Neither the language model nor packing can be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
