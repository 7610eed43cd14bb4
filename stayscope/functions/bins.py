"""Binning of numbers into labelled or equal-width intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stayscope.functions.columns import col


def cut(v: Column | str, edges: Sequence[float | None], labels: Sequence[str]) -> Column:
    """Label of the right-closed interval ``(edge, next]`` that holds ``v``; None is no upper end."""
    v = col(v)
    chain = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        inside = (v > lo) if hi is None else (v > lo) & (v <= hi)
        chain = F.when(inside, label) if chain is None else chain.when(inside, label)
    return chain


def equal_width_right_closed(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Index from 0 of ``bins`` right-closed intervals over [lo, hi]; the first takes its left edge."""
    at = F.ceil((v - lo) / (hi - lo) * bins) - 1
    return F.when(hi > lo, F.greatest(at, F.lit(0))).otherwise(F.lit(0)).cast("int")


def equal_width_left_closed(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Index from 0 of ``bins`` left-closed intervals over [lo, hi]; the last takes its right edge."""
    at = F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1))
    return F.when(hi > lo, at).otherwise(F.lit(0)).cast("int")
