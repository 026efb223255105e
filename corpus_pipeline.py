"""A corpus pipeline over the documents table: quality, lines, near copies, benchmark text, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tractwise.llm.decontaminate import remove
from tractwise.llm.lines import dedup_lines
from tractwise.llm.ngram_join import one_of_each
from tractwise.llm.packing import placements
from tractwise.llm.rules import accepted, fit_tables, with_statistics
from tractwise.session import scratch_path, settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from the labelled ones, accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = docs.select("doc_id", "text").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    model = fit_tables(settle(with_statistics(known, "stats", ["doc_id"])), labels)
    return accepted(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat, or nearly repeat, an earlier one."""
    return dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words of benchmark items."""
    return remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of at most 1024 ids."""
    return placements(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram jaccard join", near_copies),
    ("benchmark decontamination", decontaminate),
    ("packing", packing),
]

#: The packing stage can't be told in SQL: its rows are tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
