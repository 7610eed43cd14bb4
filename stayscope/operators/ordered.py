"""Order-dependent operators that never put one group into one task.

Running totals and ranks work on value histograms in ranges: totals per range are
added up first, then only the values inside one range are sorted together.
Quantiles are selected by narrowing from bucket counts. A group that holds a third
of the data is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayscope.functions.columns import columns_except, join_null_safe, micros
from stayscope.session import reliable_checkpoint, written_table

_STEPS_PER_OCTAVE = 16384
_FINEST = float(2**20)
#: Equal steps that one round of narrowing cuts a bucket into
_STEPS = 4096
#: Rows of a bucket that need no further round: one task may sort its values
_FEW_ROWS = 1 << 16
#: Rows of a result that are kept in the plan instead of a written table
_SMALL = 10_000


def _bucket(v: Column) -> Column:
    """Monotone bucket of ``v``: logarithmic steps of 0.004 % on both sides of zero."""
    octaves = F.log2(1.0 + F.abs(v) * _FINEST)
    return (F.signum(v) * F.floor(octaves * _STEPS_PER_OCTAVE)).cast("bigint")


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once: small results become constants of the plan, others a written table.

    Runs at once. Spark knows the size of both, so it decides by it whether a join broadcasts.
    """
    return _settled(df, name)[0]


def _settled(df: DataFrame, name: str) -> tuple[DataFrame, pa.Table | None]:
    """As ``settled``, with the rows themselves if they are few."""
    head = df.limit(_SMALL + 1).toArrow()
    if head.num_rows > _SMALL:
        return written_table(df, name), None
    return df.sparkSession.createDataFrame(head, df.schema), head


def _widest(found: DataFrame, head: pa.Table | None) -> int | None:
    """Most rows of a bucket that holds more than one value."""
    if head is None:
        return found.filter("_lo < _hi").agg(F.max("_n")).first()[0]
    return pc.max(head.filter(pc.less(head.column("_lo"), head.column("_hi"))).column("_n")).as_py()


def running_totals(hist: DataFrame, by: Sequence[str], value: str, weights: Sequence[str]) -> DataFrame:
    """Add ``<w>_before`` (sum over smaller values) and ``<w>_total`` for each weight.

    ``hist`` holds one row per group and value; no value may be NULL. It is
    written once, in ranges of group and value, so a group of any number of values lies in as
    many ranges as its share. Sums run over the ranges of a group first, of which
    there are no more than partitions, then inside each range. Runs at once.
    """
    by = list(by)
    order = [*by, value]
    ranged = hist.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    placed = written_table(ranged, "ranged-values")
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    group = W.partitionBy(*by)
    starts = placed.groupBy(*by, "_range").agg(*[F.sum(w).alias(f"_{w}") for w in weights])
    starts = starts.select(
        *by,
        "_range",
        *[F.coalesce(F.sum(f"_{w}").over(earlier), F.lit(0)).alias(f"_{w}_start") for w in weights],
        *[F.sum(f"_{w}").over(group).alias(f"{w}_total") for w in weights],
    )
    smaller = W.partitionBy(*by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    placed = join_null_safe(placed, starts, [*by, "_range"])
    return placed.select(
        *hist.columns,
        *[
            (F.col(f"_{w}_start") + F.coalesce(F.sum(w).over(smaller), F.lit(0))).alias(f"{w}_before")
            for w in weights
        ],
        *[f"{w}_total" for w in weights],
    )


def _at_ranks(counts: DataFrame, within: Sequence[str], step: str, ranks: Sequence[Column]) -> DataFrame:
    """Buckets of ``counts`` that hold a wanted rank, with ``_before``, the number of smaller values in the group.

    Buckets are ordered by ``step`` in each partition ``within``, whose own numbers before and in all are ``_base`` and ``_total``.
    """
    before = F.sum("_n").over(W.partitionBy(*within).orderBy(step).rowsBetween(W.unboundedPreceding, -1))
    placed = counts.withColumn("_before", F.col("_base") + F.coalesce(before, F.lit(0)))
    hit = F.lit(False)
    for rank in ranks:
        hit = hit | ((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")))
    return placed.filter(hit)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], count: str | None = None) -> DataFrame:
    """Linear-interpolated quantiles per group, one column per name in ``probs``; ``count`` names one for the number of values.

    Selection by narrowing: the first round counts the rows of each bucket of
    values, with its least and greatest value, and keeps the buckets that hold a wanted rank.
    If they hold one value each, that is it. Otherwise the rows inside
    them alone are read again, in equal steps between their ends, until a bucket
    is of one value or few rows. What is shuffled are counts of buckets, never
    rows or all distinct values; a window orders the buckets of one group, of
    which there is a fixed number at most. Runs at once and reads ``df`` once a round.
    """
    by = list(by)
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")).withColumn("_b", _bucket(F.col("_v")))
    ends = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    positions = {name: F.lit(float(p)) * (F.col("_total") - 1) for name, p in probs.items()}
    ranks = [f(p) for p in positions.values() for f in (F.floor, F.ceil)]
    counts = rows.groupBy(*by, "_b").agg(*ends)
    counts = counts.withColumns({"_total": F.sum("_n").over(W.partitionBy(*by)), "_base": F.lit(0).cast("bigint")})
    columns = [*by, "_b", "_lo", "_hi", "_n", "_before", "_total"]
    found, head = _settled(_at_ranks(counts, by, "_b", ranks).select(*columns), "quantile-buckets")
    while (most := _widest(found, head)) is not None:
        wide = found.filter("_lo < _hi").select(*by, "_b", "_lo", "_hi", F.col("_before").alias("_base"), "_total")
        inside = join_null_safe(rows, wide, [*by, "_b"]).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        cell = [*by, "_b", "_lo", "_hi", "_base", "_total"]
        step = F.col("_v") if most <= _FEW_ROWS else F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * _STEPS)
        narrow = inside.groupBy(*cell, step.alias("_step")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        narrow = _at_ranks(narrow, cell, "_step", ranks).withColumns({"_lo": F.col("_least"), "_hi": F.col("_most")}).select(*columns)
        found, head = _settled(found.filter("_lo = _hi").unionByName(narrow), "quantile-buckets")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.col("_lo")))

    parts = []
    for name, position in positions.items():
        parts += [at(F.floor(position)).alias(f"_{name}_lo"), at(F.ceil(position)).alias(f"_{name}_hi"), F.max(position - F.floor(position)).alias(f"_{name}_w")]
    picked = found.groupBy(*by).agg(*parts, F.max("_total").alias("_count"))
    return picked.select(
        *by,
        *([F.col("_count").alias(count)] if count else []),
        *[
            (F.col(f"_{k}_lo") + (F.col(f"_{k}_hi") - F.col(f"_{k}_lo")) * F.col(f"_{k}_w")).alias(k)
            for k in probs
        ],
    )


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value with its count ``n`` and tie-averaged ``rank`` (from 1)."""
    hist = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(hist, by, value, ["n"])
    return placed.select(*by, value, "n", (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("rank"))


def global_positions(df: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Number all rows from 1 in a total order without a single-partition sort.

    Rows are range-partitioned and the sorted result is written to the shared
    checkpoint folder, so that partition sizes and contents stay fixed even when
    an executor is lost.
    """
    fixed = reliable_checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order))
    tagged = fixed.withColumn("_part", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id())
    sizes = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # one row per partition, so its size is bounded by the partition count
    placed = tagged.join(F.broadcast(offsets), "_part")
    local = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select(*df.columns, (F.col("_offset") + local + 1).alias(name))


def carry_forward(
    df: DataFrame, by: Sequence[str], order: Sequence[str], time: str, cols: Sequence[str], bucket_hours: int = 24 * 7
) -> DataFrame:
    """Fill NULLs with the latest earlier value of the same group.

    ``order`` starts with ``time``. Inside a time bucket a window does the work;
    across buckets only the last known value of each bucket travels.
    """
    by = list(by)
    width = bucket_hours * 3_600_000_000
    placed = df.withColumn("_b", F.floor(micros(time) / width).cast("bigint"))
    stamp = F.struct(*order)
    last = placed.groupBy(*by, "_b").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), stamp)).alias(f"_last_{c}") for c in cols]
    )
    earlier = W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select(
        *by, "_b", *[F.last(f"_last_{c}", ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in cols]
    )
    inside = W.partitionBy(*by, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = join_null_safe(placed, carried, [*by, "_b"])
    return filled.select(
        *[
            F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_carry_{c}")).alias(c) if c in cols else F.col(c)
            for c in df.columns
        ]
    )


def asof_backward(
    probes: DataFrame,
    events: DataFrame,
    by: Sequence[str],
    probe_time: str,
    event_time: str,
    value: str,
    lookback_hours: float,
    tie: str | None = None,
) -> DataFrame:
    """Latest event value in ``[probe - lookback, probe)`` for each probe row.

    Time is cut into buckets as wide as the look-back. The answer lies in the
    probe's own bucket or in the bucket before it, whose latest event is one
    pre-aggregated row; both are found by one window. Adds ``value`` and ``event_time`` columns,
    NULL where nothing was found. ``tie`` orders events of equal time.
    """
    by = list(by)
    width = int(lookback_hours * 3_600_000_000)

    def bucket(t: str) -> Column:
        return F.floor(micros(t) / width).cast("bigint")

    tie_col = F.col(tie).cast("bigint") if tie else F.lit(0).cast("bigint")
    found = F.struct(F.col(event_time).alias("t"), tie_col.alias("tie"), F.col(value).alias("v"))
    known = events.filter(F.col(value).isNotNull()).select(
        *by, bucket(event_time).alias("_b"), F.col(event_time).alias("_t"), found.alias("_hit")
    )
    rest = columns_except(probes, by)
    left = probes.select(
        *by, bucket(probe_time).alias("_b"), F.col(probe_time).alias("_t"), F.struct(*rest).alias("_row")
    )
    previous = known.groupBy(*by, (F.col("_b") + 1).alias("_b")).agg(F.max("_hit").alias("_hit")).withColumn("_t", F.col("_hit.t"))
    no_row = F.lit(None).cast(left.schema["_row"].dataType)
    stacked = left.withColumn("_hit", F.lit(None).cast(known.schema["_hit"].dataType)).unionByName(
        known.unionByName(previous).withColumn("_row", no_row)
    )
    # a probe sorts before events of the same instant, so those stay outside the open bound
    upto = (
        W.partitionBy(*by, "_b")
        .orderBy("_t", F.col("_row").isNull(), F.col("_hit.tie").asc_nulls_first())
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    hit = F.last("_hit", ignorenulls=True).over(upto)
    joined = stacked.withColumn("_hit", hit).filter(F.col("_row").isNotNull())
    in_reach = micros(F.col("_hit.t")) >= micros(F.col("_t")) - width
    joined = joined.withColumn("_hit", F.when(in_reach, F.col("_hit")))
    return joined.select(
        *by,
        *[F.col(f"_row.{c}").alias(c) for c in rest],
        F.col("_hit.v").alias(value),
        F.col("_hit.t").alias(event_time if event_time not in rest else f"{event_time}_found"),
    )


def interval_join(
    events: DataFrame, spans: DataFrame, key: str, time: str, low: str, high: str, bin_hours: int = 24
) -> DataFrame:
    """Pair each event with every span of its key that contains it, both ends included.

    Spans are cut into time bins, so the join is an equi join on key and bin: a
    key with very many events is spread over its bins. Each pair meets in one
    bin only, the event's own.
    """
    width = bin_hours * 3_600_000_000
    first, last = F.floor(micros(low) / width), F.floor(micros(high) / width)
    binned = spans.filter(F.col(low) <= F.col(high)).withColumn(
        "_bin", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint")))
    )
    placed = events.withColumn("_bin", F.floor(micros(time) / width).cast("bigint"))
    return (
        placed.join(binned, [key, "_bin"])
        .filter((F.col(time) >= F.col(low)) & (F.col(time) <= F.col(high)))
        .drop("_bin")
    )
