"""First-generation scores: windows from admission, rule aggregation, imputation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayscope.functions import sofa_rules as rules_
from stayscope.operators.extract import eligible_stays, label_cohort
from stayscope.operators.imputation import WINDOW, fill_parameters, population_medians, wide_parameters, window_aggregates
from stayscope.operators.windows import add_window_bounds, events_in_windows, window_numbers
from stayscope.session import written_table

PARAMETERS = [
    "pao2", "fio2", "spo2", "map", "platelets", "bilirubin", "gcs_total", "creatinine", "urine_output_24h",
    "dopamine_dose", "epinephrine_dose", "norepinephrine_dose", "dobutamine_dose",
]
FLAGS = {
    "map": "map_imputed", "platelets": "platelets_imputed", "bilirubin": "bilirubin_imputed", "gcs_total": "gcs_imputed",
    "creatinine": "creatinine_imputed", "urine_output_24h": "urine_output_imputed",
}


@dataclass(frozen=True)
class WindowSettings:
    """Settings whose values the published code leaves open. No stay, window or score is dropped unless a bound is set."""

    hours: int = 24
    max_windows: int | None = None
    min_measurements: int = 1  # 0 keeps windows without any, which only imputation can fill
    lookback_hours: float | None = 24.0
    use_medians: bool = True
    median_min_count: int = 10
    max_missing: int | None = None
    min_stay_hours: float | None = None
    max_stay_days: float | None = None
    # published behaviour loses the doses before scoring; True keeps them
    use_doses: bool = False


def oxygen_ratios(df: DataFrame) -> DataFrame:
    """Arterial and saturation ratio; the second stands in only where the first is missing."""
    return (
        df.withColumn("pao2_fio2_ratio", rules_.oxygen_ratio(F.col("pao2"), F.col("fio2")))
        .withColumn("spo2_fio2_ratio", rules_.oxygen_ratio(F.col("spo2"), F.col("fio2")))
        .withColumn("spo2_fio2_surrogate", F.col("pao2_fio2_ratio").isNull() & F.col("spo2_fio2_ratio").isNotNull())
    )


def score_windows(df: DataFrame, use_doses: bool = False) -> DataFrame:
    """Subscores, total, severity, missing systems and notes for windows with parameters."""
    ratio = F.coalesce("pao2_fio2_ratio", "spo2_fio2_ratio")
    ventilated = F.col("is_mechanically_ventilated")

    def dose(name: str) -> Column:
        return F.col(f"{name}_dose") if use_doses else F.lit(None).cast("double")

    cardio = rules_.table_cardiovascular(
        F.col("map"), dose("dopamine"), dose("epinephrine"), dose("norepinephrine"), dose("dobutamine")
    )
    scores = {
        "respiratory": rules_.table_respiratory(ratio, ventilated),
        "cardiovascular": cardio,
        "coagulation": rules_.table_coagulation(F.col("platelets")),
        "liver": rules_.table_liver(F.col("bilirubin")),
        "cns": rules_.table_cns(F.col("gcs_total")),
        "renal": rules_.table_renal(F.col("creatinine"), F.col("urine_output_24h")),
    }
    scored = df.select("*", *[c.cast("int").alias(f"sofa_{n}_subscore") for n, c in scores.items()])
    sub = {n: F.col(f"sofa_{n}_subscore") for n in scores}
    reasons = {
        "Respiratory": rules_.describe_respiratory(ratio, ventilated),
        "Cardiovascular": rules_.describe_cardiovascular(sub["cardiovascular"]),
        "Coagulation": rules_.describe("coagulation", sub["coagulation"]),
        "Liver": rules_.describe("liver", sub["liver"], F.col("bilirubin")),
        "CNS": rules_.describe("cns", sub["cns"], F.col("gcs_total")),
        "Renal": rules_.describe("renal", sub["renal"]),
    }
    notes = [F.when(sub[n].isNotNull(), F.concat(F.lit(f"{title}: "), text)) for (title, text), n in zip(reasons.items(), sub)]
    return (
        scored.withColumn("sofa_total", rules_.total_score(sub))
        .withColumn("missing_components", rules_.missing_components(sub))
        .withColumn("sofa_severity", rules_.severity(F.col("sofa_total")))
        .withColumn("calculation_notes", F.concat_ws("; ", *notes))
    )


def windowed_scores(events: DataFrame, stays: DataFrame, rules: DataFrame, cohort: DataFrame, settings: WindowSettings = WindowSettings()) -> DataFrame:
    """Scored windows of all eligible stays.

    ``events`` are silver rows (subject, stay, time, concept, value); ``rules``
    map parameters to concepts and aggregations; ``cohort`` lists the patients
    whose medians fill gaps and who carry the cohort label. Writes the windows and medians at once.
    """
    eligible = eligible_stays(stays, settings.min_stay_hours, settings.max_stay_days).drop("duration_hours")
    placed = events_in_windows(events, eligible, settings.hours, settings.max_windows)
    # a stay's columns follow from its ids; as keys they need no join later
    keys = [*eligible.columns, "window_number"]
    wide = wide_parameters(window_aggregates(placed, keys), rules, PARAMETERS, keys).filter(F.col("measurements") >= settings.min_measurements)
    if settings.min_measurements < 1:
        empty = window_numbers(eligible, settings.hours, settings.max_windows).join(wide, WINDOW, "left_anti")
        wide = wide.unionByName(empty.withColumn("measurements", F.lit(0).cast("bigint")), allowMissingColumns=True)
    # one row per window, read for what is empty and for the rest
    kept = written_table(add_window_bounds(wide, settings.hours).drop("outtime"), "windows")
    # a row per concept, which the filling plan would otherwise work out once for every parameter
    medians = written_table(population_medians(events, cohort, settings.median_min_count), "medians") if settings.use_medians else None
    complete = fill_parameters(kept, events, rules, PARAMETERS, medians, settings.lookback_hours)
    filled = complete.withColumns(
        {
            **{flag: F.array_contains("imputed", p) for p, flag in FLAGS.items()},
            "is_mechanically_ventilated": F.lit(False), "pao2_fio2_imputed": F.lit(False),
        }
    ).drop("imputed")
    scored = score_windows(oxygen_ratios(filled), settings.use_doses)
    if settings.max_missing is not None:
        scored = few_missing(scored, settings.max_missing)
    return label_cohort(scored, cohort)


def few_missing(scored: DataFrame, most: int) -> DataFrame:
    """Windows in which at most ``most`` organ systems have no value."""
    return scored.filter(F.size("missing_components") <= most)
