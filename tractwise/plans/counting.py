"""FASTA files to histograms in one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tractwise.functions.columns import file_group, stem
from tractwise.operators.histograms import add_positions
from tractwise.operators.reads import build_histogram, read_lengths
from tractwise.params import MOTIF
from tractwise.sources.files import FASTA_GLOB, listed, read_fasta, sample_key


def count_fasta(spark: SparkSession, paths: str | Sequence[str], profile: str = "restrictive",
                motif: str = MOTIF, nested: bool = False) -> DataFrame:
    """The long histogram table; a file is a sample, its group comes from its name."""
    records = read_fasta(spark, paths, nested)
    found = listed(spark, paths, FASTA_GLOB, nested).select(
        F.lit("all").alias("dataset"), file_group(F.col("file")).alias("grp"), "path", "file")
    reads = records.select(
        F.lit("all").alias("dataset"), "grp",
        sample_key(found, stem(F.col("file"))).alias("sample"), "seq")
    return add_positions(build_histogram(read_lengths(reads, motif, profile)))
