"""Duplicate handling."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayscope.functions.columns import columns_except


def dedup_unique_key(df: DataFrame, keys: Sequence[str], prefer: str = "id") -> DataFrame:
    """Keep one row per key as a unique constraint would.

    Rows with a NULL in any key column never conflict, so all of them stay. Of
    equal keys the row with the smallest ``prefer`` survives. The partial
    aggregation drops most repeats before the shuffle.
    """
    complete = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    rest = [prefer, *columns_except(df, [*keys, prefer])]
    # an incomplete key gets the row's own id as an extra key, so it meets no other row
    alone = F.when(~complete, F.col(prefer)).alias("_alone")
    # rows of equal key are found by sorting; a hash in front settles nearly all comparisons
    unique = df.groupBy(F.xxhash64(*keys).alias("_hash"), *keys, alone).agg(F.min(F.struct(*rest)).alias("_kept"))
    return unique.select(*[F.col(c) if c in keys else F.col(f"_kept.{c}").alias(c) for c in df.columns])


def latest_order(time: str, tie: str) -> Column:
    """Ordering in which a NULL time counts as the latest."""
    return F.struct(F.col(time).isNull(), F.col(time), F.col(tie))


def dedup_latest(df: DataFrame, keys: Sequence[str] = ("subject_id", "itemid", "charttime"), time: str = "storetime", tie: str = "bronze_id") -> DataFrame:
    """Latest row per key; NULL keys equal each other and a NULL ``time`` is latest."""
    rest = columns_except(df, keys)
    kept = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), latest_order(time, tie)).alias("_kept"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"_kept.{c}").alias(c) for c in df.columns])


def count_resolved(df: DataFrame, keys: Sequence[str] = ("subject_id", "itemid", "charttime")) -> DataFrame:
    """How many rows ``dedup_latest`` drops."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.sum("n").alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        F.sum(F.col("n") - 1).alias("duplicates_resolved"),
    )
