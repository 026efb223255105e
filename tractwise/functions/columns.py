"""Column expressions: labels, file names, intervals and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tractwise.params import CONTRACTION, DAY0, EXPANSION, NEUTRAL, TREATED

INFINITY = float("inf")


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(INFINITY))


def to_number(text: Column) -> Column:
    """Text to double; NULL where it is not a number."""
    plain = F.trim(text)
    shown = plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") | F.lower(plain).rlike(r"^[+-]?inf(inity)?$")
    number = F.when(shown, plain.try_cast("double"))
    return F.when(~F.isnan(number), number)


def tau_label(value: Column, tau: float) -> Column:
    return F.when(value > tau, EXPANSION).when(value < -tau, CONTRACTION).otherwise(NEUTRAL)


def band_label(lower: Column, upper: Column, tau: float) -> Column:
    return F.when(lower > tau, EXPANSION).when(upper < -tau, CONTRACTION).otherwise(NEUTRAL)


def agreed_label(first: Column, second: Column) -> Column:
    return F.when(first == second, first).otherwise(NEUTRAL)


def cluster_type(mean_center: Column, tau: float) -> Column:
    return (
        F.when(mean_center > tau, "expansion-dominant")
        .when(mean_center < -tau, "contraction-dominant")
        .otherwise("neutral-like")
    )


def proxy_label(value: Column, tau: float, positive: str = EXPANSION) -> Column:
    """1 for the positive direction, 0 for the opposite one, NULL inside the band."""
    up, down = (1, 0) if positive == EXPANSION else (0, 1)
    return F.when(value > tau, up).when(value < -tau, down)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def sample_name(name: Column) -> Column:
    """Base name without its profile suffix, or without its extension where it has none."""
    base = base_name(name)
    marked = r"\.(rest|per)\.histogram$"
    return F.when(base.rlike(marked), F.regexp_replace(base, marked, "")).otherwise(stem(base))


def file_group(name: Column, default: str = DAY0) -> Column:
    """Group from the file name; the treated marks are looked for first."""
    lowered = F.lower(base_name(name))

    def has(*marks: str) -> Column:
        found = F.lit(False)
        for mark in marks:
            found = found | lowered.contains(mark)
        return found

    return (
        F.when(has("treated", "day_42", "d42"), TREATED)
        .when(has("day0", "day_0", "d0"), DAY0)
        .otherwise(default)
    )


def overlap_share(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Intersection over hull of two closed intervals, measured as end minus start."""
    inner = F.greatest(F.lit(0.0), F.least(a2, b2) - F.greatest(a1, b1))
    hull = F.greatest(a2, b2) - F.least(a1, b1)
    return F.when(hull > 0, inner / hull).otherwise(0.0)


def length_text(value: Column) -> Column:
    """Whole lengths print without a decimal point."""
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(
        value.cast("string"))


def euclid(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v))
