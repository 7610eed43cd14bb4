"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MICROS_PER_HOUR = 3_600_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(t: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(col(t).cast("timestamp"))


def from_micros(us: Column | str) -> Column:
    return F.timestamp_micros(col(us)).cast("timestamp_ntz")


def hours_between(start: Column | str, end: Column | str) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(MICROS_PER_HOUR))


def whole_days_between(start: Column | str, end: Column | str) -> Column:
    """Elapsed whole days, not calendar days."""
    return F.floor((micros(end) - micros(start)) / F.lit(24 * MICROS_PER_HOUR)).cast("bigint")


def add_hours(t: Column | str, hours: float) -> Column:
    return from_micros(micros(t) + F.lit(int(hours * MICROS_PER_HOUR)))


def contains_any(text: Column | str, terms: Iterable[str]) -> Column:
    """Case-insensitive substring test against several terms."""
    lowered = F.lower(col(text))
    return reduce(lambda a, b: a | b, [lowered.contains(t.lower()) for t in terms], F.lit(False))


def is_true(condition: Column) -> Column:
    """Three-valued condition collapsed to true or false."""
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    return is_true(condition).cast("int")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return round_to(F.when(whole != 0, part * 100.0 / whole), digits)


def nan_to_null(c: Column | str) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def number_text(v: Column | str) -> Column:
    """Plain decimal text without exponent or trailing zeros."""
    fixed = col(v).cast("decimal(28,6)").cast("string")
    return F.rtrim(F.rtrim(fixed, F.lit("0")), F.lit("."))


def columns_except(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in df.columns if c not in names]


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which NULL keys match each other; keeps the left keys once."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *columns_except(right, keys)
    )
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    joined = left.join(renamed, on, how)
    return joined.drop(*[f"__r_{k}" for k in keys])


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Constant rows as a local relation, so that Spark knows how small they are."""
    types = StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in types]
    arrow = to_arrow_schema(types)
    data = [pa.array(list(c), type=f.type) for c, f in zip(columns, arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(data, schema=arrow))


def round_to(c: Column | str, digits: int) -> Column:
    """Round half away from zero, treating a double as the decimal it stands for.

    Averages of decimals that end in an exact tie may fall a hair short of it in
    binary; the nudge is far below any shown digit and far above that error.
    """
    v = col(c).cast("double")
    return F.round(v + F.signum(v) * 1e-9, digits)
