"""Summaries of the layers and of the scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayscope.functions.columns import count_if, hours_between, join_null_safe, percent, round_to, whole_days_between
from stayscope.operators.ordered import exact_quantiles
from stayscope.operators.quality import has_flag

def _rows() -> Column:
    return F.count(F.lit(1))

SCORES = ["respiratory", "cardiovascular", "hepatic", "coagulation", "renal", "neurological"]


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("records"))


def key_counts(df: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """Rows (``_rows``) and further sums per combination of ``keys``; several distinct counts read these, not the raw rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(n) for n, c in sums.items()])


def add_distinct(base: DataFrame, ids: DataFrame, by: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """``base``, with one row per ``by``, and exact numbers of distinct values of ``ids`` (name: column).

    Each is counted on its own over the shared key rows, so that no row is
    multiplied by the number of counts.
    """
    if not by:
        # distinct first: Spark would merge plain distinct counts into one aggregation again
        return base.select("*", *[ids.select(c).distinct().agg(F.count(c)).scalar().alias(name) for name, c in columns.items()])
    for name, c in columns.items():
        base = join_null_safe(base, ids.groupBy(*by).agg(F.count_distinct(c).alias(name)), by)
    return base


def coverage_totals(df: DataFrame) -> DataFrame:
    each = key_counts(df, ["subject_id", "stay_id", "itemid"])
    total = each.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("records"))
    return add_distinct(total, each, [], {"patients": "subject_id", "stays": "stay_id", "items": "itemid"})


def coverage_by_system(df: DataFrame) -> DataFrame:
    """Patients and stays per system and their share of all patients."""
    all_patients = df.agg(F.count_distinct("subject_id").alias("n")).scalar()
    ids = df.select("sofa_system", "subject_id", "stay_id").distinct()
    found = ids.groupBy("sofa_system").agg(F.count_distinct("subject_id").alias("patients"))
    found = add_distinct(found, ids, ["sofa_system"], {"stays": "stay_id"})
    return found.withColumn("patient_percent", percent(F.col("patients"), all_patients))


def silver_by_system(silver: DataFrame) -> DataFrame:
    return silver.groupBy("sofa_system").agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("subject_id").alias("patients")
    )


def top_concepts(silver: DataFrame, n: int = 15) -> DataFrame:
    counts = silver.groupBy("concept_name").agg(F.count(F.lit(1)).alias("records"))
    return counts.orderBy(F.desc("records"), "concept_name").limit(n)


def layer_rates(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """Retention, mapping, conversion and outlier rates in one row."""
    kept = silver.agg(
        F.struct(
            F.count(F.lit(1)).alias("rows"), F.count("concept_id").alias("mapped"),
            count_if(has_flag("UNIT_CONVERTED")).alias("converted"),
            count_if(has_flag("OUTLIER_DETECTED")).alias("outliers"),
        )
    ).scalar()
    return bronze.agg(
        F.count(F.lit(1)).alias("bronze_records"),
        count_if(~F.col("is_outlier") & ~F.col("is_suspicious")).alias("quality_records"),
    ).select(
        "bronze_records", "quality_records", kept["rows"].alias("silver_records"),
        percent(F.col("quality_records"), F.col("bronze_records")).alias("retention_rate"),
        percent(kept["mapped"], kept["rows"]).alias("mapping_rate"),
        percent(kept["converted"], kept["rows"]).alias("conversion_rate"),
        percent(kept["outliers"], kept["rows"]).alias("outlier_rate"),
    )


def silver_summary(df: DataFrame) -> DataFrame:
    """Scalar metrics of the first-generation silver table."""
    flags = {c: F.when(F.col(c), 1).otherwise(0) for c in ("is_outlier", "error_flag")}
    each = key_counts(df, ["subject_id", "stay_id", "concept_id", "itemid"], **flags)
    total = each.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("total_records"), F.sum("is_outlier").alias("outliers"), F.sum("error_flag").alias("errors"))
    return add_distinct(total, each, [], {"unique_patients": "subject_id", "unique_stays": "stay_id", "unique_concepts": "concept_id", "unique_items": "itemid"})


def patient_summaries(silver: DataFrame) -> DataFrame:
    """One row per patient.

    Distinct counts come from a first aggregation per patient, admission and
    item, so rows are not multiplied and a large patient is split.
    """
    # Concepts averaged per patient, with decimals
    concepts = {
        "avg_heart_rate": ("Heart Rate", 1), "avg_resp_rate": ("Respiratory Rate", 1),
        "avg_spo2": ("Oxygen Saturation", 1), "avg_creatinine": ("Creatinine", 2),
        "avg_ph": ("pH", 2), "avg_lactate": ("Lactate", 2),
    }
    rows = silver.filter(F.col("valuenum_std").isNotNull())
    fine = rows.groupBy("subject_id", "hadm_id", "itemid", "concept_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("valuenum_std").alias("value_sum"),
        F.min("charttime").alias("t0"), F.max("charttime").alias("t1"),
        count_if(has_flag("OUTLIER_DETECTED")).alias("outliers"),
        count_if(has_flag("UNIT_CONVERTED")).alias("conversions"),
        count_if(F.col("source_table") == "chartevents").alias("chart"),
        count_if(F.col("source_table") == "labevents").alias("lab"),
    )

    def mean_of(concept: str, digits: int) -> Column:
        wanted = F.col("concept_name") == concept
        return round_to(F.sum(F.when(wanted, F.col("value_sum"))) / F.sum(F.when(wanted, F.col("n"))), digits)

    base = fine.groupBy("subject_id").agg(
        F.sum("n").alias("total_measurements"),
        F.min("t0").alias("first_measurement"),
        F.max("t1").alias("last_measurement"),
        whole_days_between(F.min("t0"), F.max("t1")).alias("measurement_span_days"),
        *[mean_of(c, d).alias(name) for name, (c, d) in concepts.items()],
        F.sum("outliers").alias("outlier_count"),
        F.sum("conversions").alias("unit_conversions"),
        percent(F.sum("outliers"), F.sum("n")).alias("outlier_percentage"),
        F.sum("chart").alias("chart_measurements"),
        F.sum("lab").alias("lab_measurements"),
    )
    return add_distinct(base, fine, ["subject_id"], {"total_admissions": "hadm_id", "unique_parameters": "itemid"})


def clinical_indicators(silver: DataFrame) -> DataFrame:
    """Statistics per concept and unit with exact percentiles.

    ``DUPLICATE_RESOLVED`` is never raised by the layers here, but counted as the
    view defines it.
    """
    keys = ["concept_name", "standard_unit"]
    rows = silver.filter(F.col("valuenum_std").isNotNull()).withColumnRenamed("unit_std", "standard_unit")
    outlier, converted = has_flag("OUTLIER_DETECTED"), has_flag("UNIT_CONVERTED")
    base = rows.groupBy(*keys).agg(
        _rows().alias("total_measurements"),
        round_to(F.avg("valuenum_std"), 3).alias("mean_value"),
        round_to(F.stddev_samp("valuenum_std"), 3).alias("std_deviation"),
        round_to(F.min("valuenum_std"), 3).alias("min_value"),
        round_to(F.max("valuenum_std"), 3).alias("max_value"),
        count_if(outlier).alias("outlier_count"),
        count_if(converted).alias("unit_conversions"),
        count_if(has_flag("DUPLICATE_RESOLVED")).alias("duplicates_resolved"),
        percent(count_if(outlier), _rows()).alias("outlier_percentage"),
        percent(count_if(converted), _rows()).alias("conversion_percentage"),
        F.min("charttime").alias("earliest_measurement"),
        F.max("charttime").alias("latest_measurement"),
        whole_days_between(F.min("charttime"), F.max("charttime")).alias("measurement_span_days"),
    )
    marks = exact_quantiles(rows, keys, "valuenum_std", {"p05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "p95": 0.95})
    ids = rows.select(*keys, "subject_id", "hadm_id").distinct()
    base = add_distinct(base, ids, keys, {"unique_patients": "subject_id", "unique_admissions": "hadm_id"})
    joined = join_null_safe(base, marks, keys)
    return joined.withColumns({c: round_to(c, 3) for c in ("p05", "q25", "median", "q75", "p95")})


def daily_trends(silver: DataFrame) -> DataFrame:
    rows = silver.filter(F.col("valuenum_std").isNotNull())
    return rows.groupBy(F.to_date("charttime").alias("measurement_date"), "concept_name").agg(
        _rows().alias("daily_measurements"),
        F.count_distinct("subject_id").alias("unique_patients"),
        round_to(F.avg("valuenum_std"), 3).alias("daily_avg"),
        round_to(F.stddev_samp("valuenum_std"), 3).alias("daily_std"),
        round_to(F.min("valuenum_std"), 3).alias("daily_min"),
        round_to(F.max("valuenum_std"), 3).alias("daily_max"),
        count_if(has_flag("OUTLIER_DETECTED")).alias("daily_outliers"),
    )


def hourly_patterns(silver: DataFrame) -> DataFrame:
    rows = silver.filter(F.col("valuenum_std").isNotNull())
    return rows.groupBy(F.hour("charttime").alias("measurement_hour"), "concept_name").agg(
        _rows().alias("hourly_measurements"),
        round_to(F.avg("valuenum_std"), 3).alias("hourly_avg"),
        round_to(F.stddev_samp("valuenum_std"), 3).alias("hourly_std"),
    )


def quality_summary(silver: DataFrame) -> DataFrame:
    """Six metrics as rows."""
    one = silver.agg(
        _rows().alias("a"), count_if(has_flag("OUTLIER_DETECTED")).alias("d"), count_if(has_flag("UNIT_CONVERTED")).alias("e"),
        count_if(has_flag("DUPLICATE_RESOLVED")).alias("f"),
    )
    one = add_distinct(one, silver.select("subject_id", "concept_name").distinct(), [], {"b": "subject_id", "c": "concept_name"})
    return one.select(*[F.col(c).cast("string").alias(c) for c in "abcdef"]).selectExpr(
        """stack(6, 'Silver Layer Overview', 'Total Records', a, 'records',
                    'Silver Layer Overview', 'Unique Patients', b, 'patients',
                    'Silver Layer Overview', 'Unique Parameters', c, 'parameters',
                    'Data Quality', 'Outliers Detected', d, 'records',
                    'Data Quality', 'Unit Conversions', e, 'records',
                    'Data Quality', 'Duplicates Resolved', f, 'records')
           AS (metric_category, metric_name, metric_value, unit)"""
    ).orderBy("metric_category", "metric_name")


def patient_sofa_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("subject_id").agg(
        F.count_distinct("stay_id").alias("total_stays"),
        _rows().alias("total_measurements"),
        F.min("charttime").alias("first_measurement"),
        F.max("charttime").alias("last_measurement"),
        F.min("total_sofa_score").alias("min_sofa"),
        F.max("total_sofa_score").alias("max_sofa"),
        round_to(F.avg("total_sofa_score"), 2).alias("avg_sofa"),
        *[round_to(F.avg(f"{s}_score"), 2).alias(f"avg_{s}") for s in SCORES],
        round_to(F.avg("data_completeness_score"), 2).alias("avg_completeness"),
    )


def daily_sofa_trends(scores: DataFrame, high: int = 10) -> DataFrame:
    risky = count_if(F.col("total_sofa_score") >= high)
    return scores.groupBy(F.to_date("charttime").alias("measurement_date")).agg(
        F.count_distinct("subject_id").alias("unique_patients"),
        _rows().alias("total_scores"),
        round_to(F.avg("total_sofa_score"), 2).alias("avg_total_sofa"),
        F.min("total_sofa_score").alias("min_total_sofa"),
        F.max("total_sofa_score").alias("max_total_sofa"),
        risky.alias("high_risk_count"),
        percent(risky, _rows()).alias("high_risk_percentage"),
        *[round_to(F.avg(f"{s}_score"), 2).alias(f"avg_{s}") for s in ("respiratory", "cardiovascular", "renal", "neurological")],
    )


def sofa_report(scores: DataFrame, high: int = 10) -> DataFrame:
    risky = count_if(F.col("total_sofa_score") >= high)
    return scores.agg(
        _rows().alias("total_scores"),
        F.count_distinct("subject_id").alias("unique_patients"),
        round_to(F.avg("total_sofa_score"), 2).alias("avg_sofa"),
        round_to(F.avg("data_completeness_score"), 4).alias("avg_completeness"),
        risky.alias("high_risk_count"),
        percent(risky, _rows()).alias("high_risk_percentage"),
        *[round_to(F.avg(f"{s}_score"), 2).alias(f"avg_{s}") for s in SCORES],
    )


def gold_summary(scores: DataFrame) -> DataFrame:
    """First-generation score table in one row; windows are added up per stay first."""
    per_stay = scores.groupBy("subject_id", "stay_id").agg(
        _rows().alias("_rows"),
        F.sum("sofa_total").alias("_sum"),
        F.count("sofa_total").alias("_scored"),
        F.min("sofa_total").alias("_min"),
        F.max("sofa_total").alias("_max"),
        count_if(F.col("disease_type") == "ARI").alias("_ari"),
        count_if(F.col("disease_type") == "OTHER").alias("_other"),
    )
    total = per_stay.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("total_windows"),
        round_to(F.sum("_sum") / F.nullif(F.sum("_scored"), F.lit(0)), 4).alias("avg_sofa"),
        F.min("_min").alias("min_sofa"),
        F.max("_max").alias("max_sofa"),
        F.coalesce(F.sum("_ari"), F.lit(0)).alias("ari_windows"),
        F.coalesce(F.sum("_other"), F.lit(0)).alias("other_windows"),
    )
    return add_distinct(total, per_stay, [], {"unique_patients": "subject_id", "unique_stays": "stay_id"})


def severity_histogram(scores: DataFrame, total: str = "total_sofa_score") -> DataFrame:
    """Counts per severity band and their share of all scores."""
    v = F.col(total)
    band = (
        F.when(v == 0, "0 (Normal)").when(v <= 6, "1-6 (Mild)").when(v <= 9, "7-9 (Moderate)")
        .when(v <= 12, "10-12 (Severe)").otherwise("13+ (Critical)")
    )
    counts = scores.groupBy(band.alias("severity_range")).agg(_rows().alias("n"))
    # five rows at most reach this window
    share = round_to(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 2)
    return counts.withColumn("percentage", share)


def availability(scores: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Share of scores with data per organ system, and of complete enough scores."""
    known = {s: round_to(F.avg(F.col(f"{s}_data_available").cast("int")) * 100, 2) for s in SCORES}
    return scores.agg(
        *[known[s].alias(f"{s}_percent") for s in SCORES],
        percent(count_if(F.col("data_completeness_score") >= threshold), _rows()).alias("complete_percent"),
    )


def score_range(scores: DataFrame, high: int = 10) -> DataFrame:
    per_patient = scores.groupBy("subject_id").agg(F.max("total_sofa_score").alias("top"))
    risky = per_patient.agg(count_if(F.col("top") >= high)).scalar()
    total = scores.agg(
        _rows().alias("scores"),
        F.min("total_sofa_score").alias("min_score"),
        F.max("total_sofa_score").alias("max_score"),
        round_to(F.avg("total_sofa_score"), 2).alias("avg_score"),
        round_to(F.avg(hours_between("window_start", "window_end")), 2).alias("avg_window_hours"),
    )
    ids = scores.select("subject_id", "stay_id").distinct()
    return add_distinct(total, ids, [], {"patients": "subject_id", "stays": "stay_id"}).withColumn("high_risk_patients", risky)


def assess_layers(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """Item, row and concept counts per system with the overall verdict."""
    items = bronze.groupBy("sofa_system").agg(F.count_distinct("itemid").alias("items"))
    concepts = silver.groupBy("sofa_system").agg(
        _rows().alias("silver_records"), F.count_distinct("concept_id").alias("concepts")
    )
    covered = items.agg(count_if(F.col("items") > 0)).scalar()
    verdict = F.when(covered >= 4, "GOOD").when(covered >= 2, "FAIR").otherwise("POOR")
    return items.join(concepts, "sofa_system", "left").withColumn("overall_assessment", verdict)


def missing_profile(df: DataFrame, cols: Sequence[str], threshold: float = 30.0) -> DataFrame:
    """Missing count and share per column in one pass."""
    counted = df.agg(_rows().alias("_n"), *[F.count(c).alias(c) for c in cols])
    long = counted.unpivot(["_n"], list(cols), "column_name", "present")
    missing = F.col("_n") - F.col("present")
    return long.select(
        "column_name", missing.alias("missing_count"),
        percent(missing, F.col("_n")).alias("missing_percent"),
        (missing * 100.0 / F.col("_n") > threshold).alias("mostly_missing"),
    )


def describe_scores(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, sd, min, quartiles and max per column.

    Columns are integer scores with a small fixed range, so ``percentile`` keeps
    only a handful of values in memory.
    """
    aggs = []
    for c in cols:
        v = F.col(c)
        q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        aggs.append(
            F.struct(
                F.lit(c).alias("column_name"), F.count(v).alias("n"), round_to(F.avg(v), 4).alias("mean"),
                round_to(F.stddev_samp(v), 4).alias("std"), F.min(v).cast("double").alias("min"),
                q[0].alias("q25"), q[1].alias("median"), q[2].alias("q75"), F.max(v).cast("double").alias("max"),
            )
        )
    return df.agg(F.array(*aggs).alias("s")).select(F.inline("s"))


def profile_table(df: DataFrame) -> DataFrame:
    """Rows, distinct ids and true flags, chosen from the schema."""
    ids = [f.name for f in df.schema if f.name.endswith("_id") or f.name == "itemid"]
    flags = [f.name for f in df.schema if f.dataType.typeName() == "boolean"]
    each = key_counts(df, ids, **{f"true_{c}": F.when(F.col(c), 1).otherwise(0) for c in flags})
    total = each.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("row_count"), *[F.coalesce(F.sum(f"true_{c}"), F.lit(0)).alias(f"true_{c}") for c in flags])
    return add_distinct(total, each, [], {f"distinct_{c}": c for c in ids})


def sample_row(df: DataFrame, *keys: str) -> DataFrame:
    """One row of a table as an example: that of the least keys."""
    return df.orderBy(*keys).limit(1)
