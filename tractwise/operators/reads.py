"""Reads to repeat lengths to histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tractwise.params import CYCLE_MAX, CYCLE_MIN, MOTIF

SAMPLE = ["dataset", "grp", "sample"]


def _overlap(a: str, b: str) -> bool:
    """True if an occurrence of b can start inside an occurrence of a."""
    return any(a.endswith(b[:n]) for n in range(1, len(b))) or (a != b and b in a)


def _candidate(motif: str, permissive: bool) -> str:
    """A run of the motif; permissive runs may continue after one unit with one changed base."""
    run = f"(?:{motif})+"
    if not permissive:
        return run
    changed = "|".join(f"{motif[:i]}[ACGT]{motif[i + 1:]}" for i in range(len(motif)))
    return f"{run}(?:(?!{motif})(?:{changed}){run})?"


def _run_pattern(motifs: list[str], permissive: bool) -> str:
    """Pattern whose first group is a candidate at every start of a run.

    Motifs that cannot overlap each other are found by consuming one run at a time. Others have
    runs in several frames, so every position that no motif precedes is tried.
    """
    found = "|".join(_candidate(m, permissive) for m in motifs)
    if any(_overlap(a, b) for a in motifs for b in motifs):
        starts = "|".join(f"(?<!{m}){_candidate(m, permissive)}" for m in motifs)
        return f"(?=({starts}))"
    if not permissive:
        return f"({found})"
    eaten = "|".join(f"(?:{m})+" for m in motifs)
    return f"(?=({found}))(?:{eaten})"


def repeat_length(seq: Column, motif: str = MOTIF, profile: str = "restrictive") -> Column:
    """Units in the longest run of the motif on either strand; 0 when there is none.

    A run on the reverse strand is a run of the reverse-complemented motif on the forward one,
    so one pass over the text covers both.
    """
    if profile not in ("restrictive", "permissive"):
        raise ValueError(f"unknown profile: {profile}")
    permissive = profile == "permissive"
    other = motif[::-1].translate(str.maketrans("ACGT", "TGCA"))
    strands = [motif] if other == motif else [motif, other]
    pattern = "(?i)" + _run_pattern(strands, permissive)
    runs = F.regexp_extract_all(seq, F.lit(pattern), F.lit(1))
    longest = F.array_max(F.transform(runs, F.length))
    return F.coalesce((longest / len(motif)).cast("int"), F.lit(0))


def read_lengths(reads: DataFrame, motif: str = MOTIF, profile: str = "restrictive") -> DataFrame:
    return reads.withColumn("repeat_length", repeat_length(F.col("seq"), motif, profile))


def build_histogram(lengths: DataFrame, low: int = CYCLE_MIN, high: int = CYCLE_MAX) -> DataFrame:
    """Reads per (sample, length). Partial counts leave the map side, so a hot sample stays cheap."""
    inside = F.count_if(F.col("repeat_length").between(low, high))
    # the range is tested while counting; a filter would be pushed down and detect every read twice
    counted = lengths.groupBy(
        *SAMPLE, F.col("repeat_length").cast("double").alias("repeat_length")
    ).agg(inside.cast("double").alias("reads"))
    return counted.filter(F.col("reads") > 0)
