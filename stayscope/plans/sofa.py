"""Daily organ-failure scores from the silver layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayscope.functions import sofa_rules as rules
from stayscope.operators.windows import daily_windows, latest, latest_by_concept, latest_map

WINDOW = ["subject_id", "stay_id", "window_number", "window_start", "window_end"]
SYSTEMS = ["respiratory", "cardiovascular", "hepatic", "coagulation", "renal", "neurological"]
DRUGS = "dopamine|norepinephrine|epinephrine|vasopressin"


def _of(system: str, pattern: str) -> Column:
    """Condition on a window-and-concept row; concept names are lower-cased there."""
    return (F.col("sofa_system") == system) & F.col("concept").rlike(pattern)


def window_values(silver: DataFrame, hours: int = 24) -> DataFrame:
    """Supporting values per daily window."""
    rows = silver.filter(F.col("valuenum_std").isNotNull())
    per_concept = latest_by_concept(daily_windows(rows, hours), WINDOW)
    gcs = _of("cns", "gcs")
    eye = gcs & F.col("concept").contains("eye")
    verbal = gcs & F.col("concept").contains("verbal") & ~F.col("concept").contains("eye")
    motor = gcs & F.col("concept").contains("motor") & ~F.col("concept").rlike("eye|verbal")
    wide = per_concept.groupBy(*WINDOW).agg(
        latest(_of("respiratory", "spo2|oxygen saturation")).alias("spo2"),
        latest(_of("respiratory", "fio2|inspired oxygen")).alias("fio2"),
        F.coalesce(F.bool_or(_of("respiratory", "ventilator|peep|mechanical")), F.lit(False)).alias("ventilated"),
        latest(_of("cardiovascular", "mean|map")).alias("map_measured"),
        latest(_of("cardiovascular", "systolic")).alias("systolic"),
        latest(_of("cardiovascular", "diastolic")).alias("diastolic"),
        latest_map(_of("cardiovascular", DRUGS)).alias("vasopressor_doses"),
        latest(_of("liver", "bilirubin")).alias("bilirubin_level"),
        latest(_of("coagulation", "platelet")).alias("platelet_count"),
        latest(_of("renal", "creatinine")).alias("creatinine_level"),
        F.sum(F.when(_of("renal", "urine|foley"), F.col("value_sum"))).alias("urine_output_24h"),
        latest(eye).alias("gcs_eye"),
        latest(verbal).alias("gcs_verbal"),
        latest(motor).alias("gcs_motor"),
    )
    return wide.select(
        *WINDOW,
        rules.oxygen_ratio(F.col("spo2") * 1.5, F.col("fio2")).alias("pao2_fio2_ratio"),
        "ventilated",
        F.coalesce("map_measured", (F.col("diastolic") * 2 + F.col("systolic")) / 3).alias("mean_arterial_pressure"),
        "vasopressor_doses", "bilirubin_level", "platelet_count", "creatinine_level", "urine_output_24h",
        (F.col("gcs_eye") + F.col("gcs_verbal") + F.col("gcs_motor")).alias("gcs_total"),
    )


def subscores(ruleset: str) -> dict[str, Column]:
    ratio, vent = F.col("pao2_fio2_ratio"), F.col("ventilated")
    map_, doses = F.col("mean_arterial_pressure"), F.col("vasopressor_doses")
    creatinine, urine = F.col("creatinine_level"), F.col("urine_output_24h")
    if ruleset == "enhanced":
        return {
            "respiratory": rules.enhanced_respiratory(ratio, vent),
            "cardiovascular": rules.enhanced_cardiovascular(map_, F.array_max(F.map_values(doses))),
            "hepatic": rules.enhanced_hepatic(F.col("bilirubin_level")),
            "coagulation": rules.enhanced_coagulation(F.col("platelet_count")),
            "renal": rules.enhanced_renal(creatinine, urine),
            "neurological": rules.enhanced_neurological(F.col("gcs_total")),
        }
    if ruleset == "table":
        drug = {n: F.try_element_at(doses, F.lit(n)) for n in ("dopamine", "epinephrine", "norepinephrine", "dobutamine")}
        return {
            "respiratory": rules.table_respiratory(ratio, vent),
            "cardiovascular": rules.table_cardiovascular(map_, **drug),
            "hepatic": rules.table_liver(F.col("bilirubin_level")),
            "coagulation": rules.table_coagulation(F.col("platelet_count")),
            "renal": rules.table_renal(creatinine, urine),
            "neurological": rules.table_cns(F.col("gcs_total")),
        }
    raise ValueError(f"unknown rule set {ruleset}")


def sofa_scores(silver: DataFrame, ruleset: str = "table", hours: int = 24) -> DataFrame:
    """One scored row per stay and daily window."""
    values = window_values(silver, hours)
    scores = subscores(ruleset)
    scored = values.select("*", *[scores[s].cast("int").alias(f"{s}_score") for s in SYSTEMS])
    available = {
        "respiratory": F.col("pao2_fio2_ratio").isNotNull(),
        "cardiovascular": F.col("mean_arterial_pressure").isNotNull() | (F.size("vasopressor_doses") > 0),
        "hepatic": F.col("bilirubin_level").isNotNull(),
        "coagulation": F.col("platelet_count").isNotNull(),
        "renal": F.col("creatinine_level").isNotNull() | F.col("urine_output_24h").isNotNull(),
        "neurological": F.col("gcs_total").isNotNull(),
    }
    total = sum((F.coalesce(F.col(f"{s}_score"), F.lit(0)) for s in SYSTEMS), F.lit(0))
    known = sum((available[s].cast("int") for s in SYSTEMS), F.lit(0))
    return scored.select(
        "subject_id", "stay_id",
        F.col("window_end").alias("charttime"), "window_start", "window_end",
        *[f"{s}_score" for s in SYSTEMS],
        total.alias("total_sofa_score"),
        "pao2_fio2_ratio", "mean_arterial_pressure", "vasopressor_doses", "bilirubin_level", "platelet_count",
        "creatinine_level", "urine_output_24h", "gcs_total", "ventilated",
        *[available[s].alias(f"{s}_data_available") for s in SYSTEMS],
        (known / 6.0).alias("data_completeness_score"),
    )
