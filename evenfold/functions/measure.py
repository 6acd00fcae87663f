"""Distances and standardisation as column expressions.

Distances that decide anything are integers in millionths ("micro units"): sums of
integers do not depend on the order of rows, so ties are true ties and the smallest
id decides them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000
# Stands for "no second medoid"; only ever an operand of least().
FAR = 9_000_000_000_000_000_000

PairDistance = Callable[[str, str], Column]


def quantise(value: Column) -> Column:
    return F.round(value * MICRO).cast("bigint")


def standardised(value: Column, mean: Column, deviation: Column) -> Column:
    """(value - mean) / deviation, and 0 for a constant column."""
    return F.when(deviation == 0, F.lit(0.0)).otherwise((value - mean) / F.nullif(deviation, F.lit(0.0)))


def _two(a: str, b: str, column: str) -> tuple[Column, Column]:
    return F.col(f"{a}{column}"), F.col(f"{b}{column}")


def manhattan(a: str, b: str) -> Column:
    """L1 distance of two profiles in micro units.

    Two different styles differ in exactly two of the one-hot columns, by the gap of
    each, so no array is walked.
    """
    total = F.lit(0).cast("bigint")
    for column in ("q_motivation", "q_esteem", "q_ethic"):
        x, y = _two(a, b, column)
        total = total + F.abs(x - y)
    x, y = _two(a, b, "Learning_Style")
    gap_x, gap_y = _two(a, b, "q_gap")
    return total + F.when(x == y, F.lit(0).cast("bigint")).otherwise(gap_x + gap_y)


def euclidean(a: str, b: str) -> Column:
    """L2 distance of two profiles, as a double."""
    total = F.lit(0.0)
    for column in ("z_motivation", "z_esteem", "z_ethic"):
        x, y = _two(a, b, column)
        total = total + (x - y) * (x - y)
    x, y = _two(a, b, "Learning_Style")
    gap_x, gap_y = _two(a, b, "z_gap")
    return F.sqrt(total + F.when(x == y, F.lit(0.0)).otherwise(gap_x * gap_x + gap_y * gap_y))


def gower(a: str, b: str) -> Column:
    """Gower distance over three scores and three categories, as a double."""
    total = F.lit(0.0)
    for score, span in (
        ("Motivation", "span_motivation"),
        ("Self_Esteem", "span_esteem"),
        ("Work_Ethic", "span_ethic"),
    ):
        x, y = _two(a, b, score)
        width = F.col(f"{a}{span}")
        total = total + F.when(width == 0, F.lit(0.0)).otherwise(F.abs(x - y) / F.nullif(width, F.lit(0.0)))
    for category in ("Gender", "Diversity", "Learning_Style"):
        x, y = _two(a, b, category)
        total = total + F.when(x.eqNullSafe(y), F.lit(0.0)).otherwise(F.lit(1.0))
    return total / 6


def gower_micro(a: str, b: str) -> Column:
    return quantise(gower(a, b))


def euclidean_micro(a: str, b: str) -> Column:
    return quantise(euclidean(a, b))


PAIR_METRICS: dict[str, PairDistance] = {
    "manhattan": manhattan,
    "euclidean": euclidean_micro,
    "gower": gower_micro,
}


def array_manhattan(x: Column, y: Column) -> Column:
    """L1 distance of two BIGINT vectors."""
    gaps = F.zip_with(x, y, lambda p, q: F.abs(p - q))
    return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, gap: total + gap)


def array_squared(x: Column, y: Column) -> Column:
    """Squared L2 distance of two vectors, as a double.

    Doubles, because the square of a rare style's gap leaves BIGINT in a class of
    some ten million people; terms are added in column order, the same everywhere.
    """
    squares = F.zip_with(x, y, lambda p, q: (p - q).cast("double") * (p - q).cast("double"))
    return F.aggregate(squares, F.lit(0.0), lambda total, square: total + square)


VECTOR_METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "manhattan": array_manhattan,
    "euclidean": array_squared,
}


def vector_metric(name: str) -> Callable[[Column, Column], Column]:
    if name not in VECTOR_METRICS:
        raise ValueError(f"unknown metric {name!r}: use one of {sorted(VECTOR_METRICS)}")
    return VECTOR_METRICS[name]


def pair_metric(name: str) -> PairDistance:
    if name not in PAIR_METRICS:
        raise ValueError(f"unknown metric {name!r}: use one of {sorted(PAIR_METRICS)}")
    return PAIR_METRICS[name]
