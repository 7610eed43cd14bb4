"""Simplified severity scores of the policy runs; a missing value adds nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def points(v: Column, over: list[tuple[float, int]]) -> Column:
    """Points of the first bound that ``v`` exceeds."""
    chain = F.when(v > over[0][0], over[0][1])
    for bound, p in over[1:]:
        chain = chain.when(v > bound, p)
    return chain.otherwise(0)


def clip(v: Column, lo: int, hi: int) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


# Fixed values: (column, [(exceeds, points), ...]) per score, and the score's upper end
FULL = {
    "apache_ii_score": ([("paco2", [(50, 3)]), ("heart_rate", [(150, 3), (110, 2)]), ("creatinine", [(3.5, 4), (2.0, 3)])], 71),
    "sofa_score": ([("respiratory_rate", [(30, 2), (25, 1)]), ("heart_rate", [(120, 2)]), ("creatinine", [(5.0, 4), (3.5, 3), (2.0, 2), (1.2, 1)])], 24),
    "saps_ii_score": ([("heart_rate", [(160, 7), (120, 4)]), ("respiratory_rate", [(35, 6)])], 163),
    "oasis_score": ([("heart_rate", [(125, 3)]), ("respiratory_rate", [(30, 1)])], 7),
}
SIMPLE = {
    "apache_ii_score": ([("heart_rate", [(150, 4), (110, 2)]), ("respiratory_rate", [(35, 4), (25, 1)]), ("creatinine", [(3.5, 4), (2.0, 3), (1.2, 2)])], 71),
    "sofa_score": FULL["sofa_score"],
    "saps_ii_score": ([("heart_rate", [(160, 7), (120, 4)])], 163),
    "oasis_score": ([("heart_rate", [(125, 3)])], 7),
}
SCORES = list(FULL)


def score(name: str, variant: str = "full") -> Column:
    parts, top = (FULL if variant == "full" else SIMPLE)[name]
    return clip(sum((points(F.col(c), over) for c, over in parts), F.lit(0)), 0, top)
