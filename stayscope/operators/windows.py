"""Stay-relative time windows from integer arithmetic on microseconds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayscope.functions.columns import MICROS_PER_HOUR, from_micros, join_null_safe, micros

STAY = ["subject_id", "stay_id"]


def _with_bounds(df: DataFrame, by: Sequence[str], time: str) -> DataFrame:
    """First and last time per group, by aggregation and join rather than a window over raw rows."""
    bounds = df.groupBy(*by).agg(F.min(micros(time)).alias("_t0"), F.max(micros(time)).alias("_t1"))
    return df.join(bounds, list(by))


def daily_windows(df: DataFrame, hours: int = 24, by: Sequence[str] = STAY, time: str = "charttime") -> DataFrame:
    """Windows ``[end - hours, end]`` closed at both ends, counted from each stay's first event.

    An event exactly on a boundary belongs to both neighbours; the part after the
    last full window and rows without a stay are left out. Adds ``window_number``,
    ``window_start`` and ``window_end``.
    """
    width = hours * MICROS_PER_HOUR
    rows = df
    for key in by:
        rows = rows.filter(F.col(key).isNotNull())
    rows = _with_bounds(rows, by, time)
    offset = micros(time) - F.col("_t0")
    own = F.expr(f"(unix_micros(cast({time} AS timestamp)) - _t0) div {width}")
    on_edge = (offset % width == 0) & (offset > 0)
    numbers = F.when(on_edge, F.array(own, own + 1)).otherwise(F.array(own + 1))
    last = F.expr(f"(_t1 - _t0) div {width}")
    rows = rows.withColumn("window_number", F.explode(numbers)).filter(F.col("window_number") <= last)
    end = F.col("_t0") + F.col("window_number") * width
    return (
        rows.withColumn("window_start", from_micros(end - width))
        .withColumn("window_end", from_micros(end))
        .drop("_t0", "_t1")
    )


def window_numbers(stays: DataFrame, hours: int = 24, max_windows: int | None = None) -> DataFrame:
    """Each stay once for every window from its admission to its discharge, whether anything happened in it or not."""
    count = F.ceil((micros("outtime") - micros("intime")) / (hours * MICROS_PER_HOUR)).cast("int")
    if max_windows is not None:
        count = F.least(count, F.lit(max_windows))
    return stays.filter(count > 0).withColumn("window_number", F.explode(F.sequence(F.lit(1), count)))


def stay_windows(stays: DataFrame, hours: int = 24, max_windows: int | None = None) -> DataFrame:
    """Half-open windows from admission to discharge, where the last one is cut; all of them unless ``max_windows`` is given."""
    width = hours * MICROS_PER_HOUR
    start, stop = micros("intime"), micros("outtime")
    rows = window_numbers(stays, hours, max_windows).withColumn("_i", F.col("window_number") - 1)
    begin = start + F.col("_i").cast("bigint") * width
    return rows.select(
        *[c for c in stays.columns if c not in ("intime", "outtime")],
        "intime",
        from_micros(begin).alias("window_start"),
        from_micros(F.least(begin + width, stop)).alias("window_end"),
        (F.col("_i") + 1).alias("window_number"),
        (F.col("_i") + 1).alias("icu_day"),
    )


def window_index(time: Column | str, start: Column | str, hours: int) -> Column:
    """Number of the half-open window that holds ``time``; zero or less before ``start``."""
    return (F.floor((micros(time) - micros(start)) / (hours * MICROS_PER_HOUR)) + 1).cast("int")


def events_in_windows(events: DataFrame, stays: DataFrame, hours: int = 24, max_windows: int | None = None, outlier: str | None = "is_outlier") -> DataFrame:
    """Events inside their stay with the stay's columns and the number of the half-open window that holds them.

    Numbers follow from admission and discharge by arithmetic, so the windows
    themselves are not joined; ``add_window_bounds`` names their start and end.
    """
    rows = events
    if outlier and outlier in events.columns:
        rows = rows.filter(~F.col(outlier))
    rows = rows.drop(*[c for c in stays.columns if c not in STAY]).join(stays, STAY)
    inside = (F.col("charttime") >= F.col("intime")) & (F.col("charttime") < F.col("outtime"))
    number = window_index("charttime", "intime", hours)
    if max_windows is not None:
        inside &= number <= max_windows
    return rows.filter(inside).withColumn("window_number", number)


def add_window_bounds(rows: DataFrame, hours: int = 24) -> DataFrame:
    """Start, end and day of the numbered window, from the stay's admission and discharge."""
    width = hours * MICROS_PER_HOUR
    begin = micros("intime") + (F.col("window_number") - 1).cast("bigint") * width
    return (
        rows.withColumn("window_start", from_micros(begin))
        .withColumn("window_end", from_micros(F.least(begin + width, micros("outtime"))))
        .withColumn("icu_day", F.col("window_number"))
    )


def policy_windows(df: DataFrame, hours: int, by: Sequence[str] = STAY, time: str = "charttime") -> DataFrame:
    """Right-closed bins from each stay's first event; the first bin includes its left edge.

    Edges run while they do not pass the last event plus one hour, and events
    beyond the last edge get no bin (``time_window`` is NULL). ``stay_start_us`` is
    the first event in microseconds, from which times of a bin may be measured.
    """
    width = hours * MICROS_PER_HOUR
    rows = _with_bounds(df, by, time)
    offset = micros(time) - F.col("_t0")
    edges = F.floor((F.col("_t1") - F.col("_t0") + MICROS_PER_HOUR) / width)
    bin_ = F.greatest(F.ceil(offset / width) - 1, F.lit(0)).cast("int")
    inside = offset <= edges * width
    has_bin = edges >= 1
    return rows.withColumn("time_window", F.when(inside & has_bin, bin_)).drop("_t1").withColumnRenamed("_t0", "stay_start_us")


def latest_by_concept(df: DataFrame, keys: Sequence[str], value: str = "valuenum_std", time: str = "charttime", tie: str = "bronze_id") -> DataFrame:
    """One row per window and concept: latest value with its time, sum and count.

    This first aggregation combines on the map side and splits even a very long
    stay over its windows and concepts; families of concepts are picked from it.
    """
    stamp = F.struct(F.col(time), F.col(tie))
    return df.groupBy(*keys, "sofa_system", F.lower("concept_name").alias("concept")).agg(
        F.max_by(value, stamp).alias("last_value"),
        F.max(stamp).alias("last_stamp"),
        F.sum(value).alias("value_sum"),
        F.count(value).alias("value_count"),
    )


def latest(condition: Column) -> Column:
    """Latest value among the concepts that satisfy ``condition`` (over ``latest_by_concept`` rows)."""
    return F.max_by(F.when(condition, F.col("last_value")), F.when(condition, F.col("last_stamp")))


def latest_map(condition: Column) -> Column:
    """Map from concept name to its latest value, for the few concepts that satisfy ``condition``."""
    return F.map_from_entries(
        F.array_sort(F.collect_list(F.when(condition, F.struct(F.col("concept").alias("key"), F.col("last_value").alias("value")))))
    )


__all__ = [
    "daily_windows", "stay_windows", "window_index", "events_in_windows", "add_window_bounds", "policy_windows",
    "latest_by_concept", "latest", "latest_map", "join_null_safe",
]
