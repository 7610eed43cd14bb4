"""Window parameters: aggregation by rule and filling of what is missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayscope.operators.ordered import asof_backward, exact_quantiles

WINDOW = ["subject_id", "stay_id", "window_number"]


def window_aggregates(events: DataFrame, keys: Sequence[str] = WINDOW, value: str = "value", time: str = "charttime", tie: str = "bronze_id") -> DataFrame:
    """All aggregates a rule may ask for, per window and concept, from one pass."""
    return events.groupBy(*keys, "concept_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min(value).alias("_min"), F.max(value).alias("_max"), F.avg(value).alias("_mean"),
        F.sum(value).alias("_sum"), F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(time, tie))).alias("_last"),
    )


def _by_rule(aggregation) -> Column:
    return (
        F.when(aggregation == "min", F.col("_min"))
        .when(aggregation == "max", F.col("_max"))
        .when(aggregation == "mean", F.col("_mean"))
        .when(aggregation == "sum", F.col("_sum"))
        .otherwise(F.col("_last"))
    )


def pick_parameters(aggregates: DataFrame, rules: DataFrame, keys: Sequence[str] = WINDOW) -> DataFrame:
    """One row per window and parameter with the aggregate its rule names.

    ``rules`` holds (parameter, concept_id, aggregation).
    """
    chosen = _by_rule(F.col("aggregation")).alias("parameter_value")
    return aggregates.join(rules, "concept_id").select(*keys, "parameter", chosen).filter(F.col("parameter_value").isNotNull())


def wide_parameters(aggregates: DataFrame, rules: DataFrame, parameters: Sequence[str], keys: Sequence[str] = WINDOW) -> DataFrame:
    """One row per window: the number of its ``measurements`` and one column per parameter."""
    # the rules list the score's few parameters
    wanted = rules.groupBy("concept_id").agg(F.collect_list(F.struct("parameter", "aggregation")).alias("_wanted"))
    rows = aggregates.join(wanted, "concept_id", "left").select("*", F.posexplode_outer("_wanted").alias("_k", "_rule"))
    once = F.when(F.coalesce("_k", F.lit(0)) == 0, F.col("rows"))
    value = _by_rule(F.col("_rule.aggregation"))
    return rows.groupBy(*keys).agg(
        F.sum(once).alias("measurements"), *[F.max(F.when(F.col("_rule.parameter") == p, value)).alias(p) for p in parameters]
    )


def aggregate_parameters(events: DataFrame, rules: DataFrame, keys: Sequence[str] = WINDOW) -> DataFrame:
    return pick_parameters(window_aggregates(events, keys), rules, keys)


def population_medians(events: DataFrame, cohort: DataFrame | None = None, min_count: int = 10, value: str = "value") -> DataFrame:
    """Exact median per concept over the cohort's patients, or over all without a cohort."""
    rows = events.filter(F.col(value).isNotNull())
    if "is_outlier" in events.columns:
        rows = rows.filter(~F.col("is_outlier"))
    if cohort is not None:
        rows = rows.join(cohort.select("subject_id").distinct(), "subject_id", "left_semi")
    keys = ["concept_id", "concept_name"]
    return exact_quantiles(rows, keys, value, {"median_value": 0.5}, count="_n").filter(F.col("_n") >= min_count).drop("_n")


def impute_locf(missing: DataFrame, events: DataFrame, lookback_hours: float = 24.0, value: str = "value") -> DataFrame:
    """Latest earlier value of the same stay and concept for each missing parameter.

    ``missing`` holds a window start and concept per row; the found value comes
    back in ``locf_value``.
    """
    source = events.filter(F.col(value).isNotNull()).select(
        "subject_id", "stay_id", "concept_id", F.col("charttime").alias("_at"), F.col(value).alias("locf_value"), "bronze_id"
    )
    return asof_backward(
        missing, source, ["subject_id", "stay_id", "concept_id"], "window_start", "_at", "locf_value", lookback_hours, tie="bronze_id"
    ).drop("_at")


def fill_parameters(
    wide: DataFrame, events: DataFrame, rules: DataFrame, parameters: Sequence[str], medians: DataFrame | None = None, lookback_hours: float | None = 24.0
) -> DataFrame:
    """``wide`` with empty parameters filled by the last observation, then the population median.

    ``imputed`` lists the filled parameters. Only what is empty is expanded to
    rows of its own.
    """
    # the rules list the score's few parameters
    listed = rules.agg(F.collect_list(F.struct("parameter", "concept_id"))).scalar()
    empty = F.array_compact(F.array(*[F.when(F.col(p).isNull(), F.lit(p)) for p in parameters]))
    open_ = wide.select(*WINDOW, "window_start", empty.alias("_empty"), listed.alias("_listed"))
    gaps = open_.select(*WINDOW, "window_start", F.inline(F.filter("_listed", lambda r: F.array_contains(F.col("_empty"), r["parameter"]))))
    asked = rules.select("concept_id").distinct()
    if lookback_hours is None:
        gaps = gaps.withColumn("locf_value", F.lit(None).cast("double"))
    else:
        gaps = impute_locf(gaps, events.join(asked, "concept_id", "left_semi"), lookback_hours)
    value = F.col("locf_value")
    if medians is not None:
        # one entry per concept of the rules, looked up in place: a join would shuffle by a handful of hot concepts
        each = medians.join(asked, "concept_id", "left_semi").groupBy("concept_id").agg(F.max("median_value").alias("m"))
        gaps = gaps.withColumn("_medians", each.agg(F.map_from_entries(F.collect_list(F.struct("concept_id", "m")))).scalar())
        value = F.coalesce(value, F.try_element_at("_medians", F.col("concept_id")))
    found = gaps.groupBy(*WINDOW).agg(*[F.max(F.when(F.col("parameter") == p, value)).alias(f"_{p}") for p in parameters])
    joined = wide.join(found, WINDOW, "left")
    filled = F.array_compact(F.array(*[F.when(F.col(p).isNull() & F.col(f"_{p}").isNotNull(), F.lit(p)) for p in parameters]))
    kept = [c for c in wide.columns if c not in parameters]
    return joined.select(*kept, *[F.coalesce(p, f"_{p}").alias(p) for p in parameters], filled.alias("imputed"))
