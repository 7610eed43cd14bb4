"""Assertions about the layers, as small DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stayscope.functions.columns import count_if, percent, round_to
from stayscope.functions.sofa_rules import COMPONENTS

SUBSCORES = [f"sofa_{c}_subscore" for c in COMPONENTS]


def _n() -> Column:
    return F.count(F.lit(1))


def v_basic(gold: DataFrame) -> DataFrame:
    return gold.agg(
        _n().alias("total_windows"), F.count_distinct("subject_id").alias("patients"),
        F.count_distinct("stay_id").alias("stays"), F.count_distinct("hadm_id").alias("admissions"),
        F.min("window_start").alias("earliest"), F.max("window_end").alias("latest"),
        round_to(F.avg("icu_day"), 4).alias("avg_icu_day"), F.max("icu_day").alias("max_icu_day"),
    )


def _per_column(df: DataFrame, cols: Sequence[str], build, name: str) -> DataFrame:
    """One pass over the table, one output row per column."""
    one = df.agg(F.array(*[F.struct(F.lit(c).alias(name), *build(c)) for c in cols]).alias("_rows"))
    return one.select(F.inline("_rows"))


def v_ranges(gold: DataFrame, total_max: int = 24, sub_max: int = 4) -> DataFrame:
    def build(c: str) -> list[Column]:
        top = total_max if c == "sofa_total" else sub_max
        return [
            F.min(c).alias("lowest"), F.max(c).alias("highest"), round_to(F.avg(c), 4).alias("average"),
            count_if((F.col(c) < 0) | (F.col(c) > top)).alias("out_of_range"),
        ]

    return _per_column(gold, ["sofa_total", *SUBSCORES], build, "column_name")


def v_consistency(gold: DataFrame) -> DataFrame:
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in SUBSCORES), F.lit(0))
    same = count_if(F.col("sofa_total") == total)
    return gold.agg(_n().alias("total_rows"), same.alias("consistent_rows"), percent(same, _n()).alias("consistency_rate"))


def v_imputation(gold: DataFrame, flags: Sequence[str]) -> DataFrame:
    return _per_column(
        gold, flags,
        lambda c: [count_if(F.col(c)).alias("imputed"), percent(count_if(F.col(c)), _n()).alias("imputation_rate")],
        "flag",
    )


def v_missing(gold: DataFrame) -> DataFrame:
    counts = gold.groupBy(F.size("missing_components").alias("missing_count")).agg(_n().alias("windows"))
    # seven rows at most
    return counts.withColumn("percentage", percent(F.col("windows"), F.sum("windows").over(W.partitionBy())))


def v_temporal(gold: DataFrame) -> DataFrame:
    return gold.agg(
        _n().alias("total_windows"),
        count_if(F.col("window_start") >= F.col("window_end")).alias("invalid_order"),
        count_if(F.col("icu_day") != F.col("window_number")).alias("day_mismatch"),
    )


def v_cohort(gold: DataFrame) -> DataFrame:
    return gold.groupBy("disease_type").agg(
        _n().alias("windows"), F.count_distinct("subject_id").alias("patients"),
        round_to(F.avg("sofa_total"), 4).alias("avg_sofa"), F.min("sofa_total").alias("min_sofa"), F.max("sofa_total").alias("max_sofa"),
    )


def v_distributions(gold: DataFrame, cols: Sequence[str]) -> DataFrame:
    return _per_column(
        gold, cols,
        lambda c: [F.count(c).alias("n"), round_to(F.avg(c), 4).alias("mean"), round_to(F.stddev_samp(c), 4).alias("std")],
        "parameter",
    )


def v_quality(df: DataFrame, by: str = "source_table") -> DataFrame:
    """Null, negative and empty values per source."""
    return df.groupBy(by).agg(
        _n().alias("records"),
        count_if(F.col("valuenum").isNull()).alias("null_valuenum"),
        count_if(F.col("valuenum") < 0).alias("negative_values"),
        count_if(F.col("value").isNull() & F.col("valuenum").isNull()).alias("no_value"),
    )


def v_transformations(silver: DataFrame) -> DataFrame:
    """Rows per kind of transformation, read from the log."""
    log = F.col("transformation_log")
    kind = (
        F.when(log.isNull() | (log == ""), "none")
        .when(log.contains("Unit converted"), "unit conversion")
        .when(log.contains("Outlier"), "outlier")
        .when(log.contains("Duplicate"), "duplicate")
        .when(log.contains("Unknown unit"), "unknown unit")
        .otherwise("other")
    )
    return silver.groupBy(kind.alias("transformation_type")).agg(_n().alias("records"))


def v_common_logs(silver: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent conversion logs."""
    rows = silver.filter(F.col("transformation_log").contains("converted"))
    return rows.groupBy("transformation_log").agg(_n().alias("records")).orderBy(F.desc("records"), "transformation_log").limit(n)


def v_concepts(silver: DataFrame) -> DataFrame:
    """Rows per concept and unit with the unit's share of its concept."""
    counts = silver.groupBy("concept_name", "unit_std").agg(_n().alias("records"), F.count_distinct("subject_id").alias("patients"))
    # one row per unit in each concept reaches the window
    return counts.withColumn("unit_percent", percent(F.col("records"), F.sum("records").over(W.partitionBy("concept_name"))))


def v_limits(silver: DataFrame, limits: DataFrame) -> DataFrame:
    """Observed range per concept against its plausible range."""
    seen = silver.filter(F.col("valuenum_std").isNotNull()).groupBy("concept_id").agg(
        _n().alias("records"), F.min("valuenum_std").alias("lowest"), F.max("valuenum_std").alias("highest"),
        round_to(F.avg("valuenum_std"), 4).alias("average"),
    )
    inside = (F.col("lowest") >= F.col("min_value")) & (F.col("highest") <= F.col("max_value"))
    return seen.join(limits.select("concept_id", "concept_name", "min_value", "max_value"), "concept_id").withColumn("within_limits", inside)


def v_schema(df: DataFrame, expected: StructType | Sequence[str]) -> DataFrame:
    """Expected columns with presence and type; read from the schema alone."""
    names = expected.fieldNames() if isinstance(expected, StructType) else list(expected)
    types: Mapping[str, str] = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = [(n, n in types, types.get(n)) for n in names]
    return df.sparkSession.createDataFrame(rows, "column_name string, present boolean, data_type string")


def v_items(df: DataFrame, n: int = 20) -> DataFrame:
    """Value range per item and source, most frequent first."""
    stats = df.filter(F.col("valuenum").isNotNull()).groupBy("itemid", "source_table").agg(
        _n().alias("records"), F.min("valuenum").alias("lowest"), F.max("valuenum").alias("highest"),
        round_to(F.avg("valuenum"), 4).alias("average"),
    )
    return stats.orderBy(F.desc("records"), "itemid", "source_table").limit(n)


def v_time_span(df: DataFrame) -> DataFrame:
    return df.groupBy("source_table").agg(
        F.min("charttime").alias("earliest"), F.max("charttime").alias("latest"),
        F.count_distinct(F.to_date("charttime")).alias("distinct_days"),
    )


def v_layers(layers: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of each layer, whether it has rows, and the share kept from the layer before."""
    parts, before = [], None
    for i, (name, df) in enumerate(layers.items()):
        part = df.agg(F.lit(i).alias("layer_order"), F.lit(name).alias("layer"), _n().alias("records"))
        parts.append(part)
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    # one row per layer
    before = F.lag("records").over(W.orderBy("layer_order"))
    return union.select(
        "layer", "records", (F.col("records") > 0).alias("present"), percent(F.col("records"), before).alias("retention_percent")
    )
