"""Outcome labels per stay, per score row and per policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayscope.functions.columns import add_hours, hours_between, is_true


def stay_mortality(stays: DataFrame, admissions: DataFrame, hours: int = 48) -> DataFrame:
    """Stay with its admission's death and whether that fell into the stay plus ``hours``."""
    joined = stays.select("subject_id", "hadm_id", "stay_id", F.col("intime").alias("icu_intime"), F.col("outtime").alias("icu_outtime")).join(
        admissions.select("hadm_id", "deathtime"), "hadm_id"
    )
    died = (F.col("deathtime") >= F.col("icu_intime")) & (F.col("deathtime") <= add_hours("icu_outtime", hours))
    return joined.withColumn(f"mortality_{hours}h", is_true(died).cast("int"))


def time_aware_dataset(scores: DataFrame, stays: DataFrame, admissions: DataFrame, hours: int = 48) -> DataFrame:
    """Score rows with the label "dies within ``hours`` after this row".

    Kept are rows whose stay lasts long enough for the follow-up, or that lie at
    least two hours before a death, from admission on.
    """
    outcome = stay_mortality(stays, admissions, hours).drop("subject_id")
    rows = scores.join(outcome, "stay_id")
    t, death = F.col("charttime"), F.col("deathtime")
    horizon = add_hours("charttime", hours)
    followed = (t <= add_hours("icu_outtime", -hours)) | is_true(t <= add_hours("deathtime", -2))
    label = is_true((death <= horizon) & (death > t)).cast("int")
    return (
        rows.filter(followed)
        .withColumn("hours_from_admission", hours_between("icu_intime", "charttime"))
        .filter("hours_from_admission >= 0")
        .withColumn("prediction_timepoint", horizon)
        .withColumn(f"target_mortality_{hours}h", label)
    )


def outcome_table(scores: DataFrame, stays: DataFrame, admissions: DataFrame, patients: DataFrame) -> DataFrame:
    """One row per patient, admission and policy: highest scores, outcomes and patient data.

    The published schema is never filled; hospital mortality is the admission's
    flag, ICU mortality a death inside the stay, 30-day mortality a death up to
    30 days after admission.
    """
    best = scores.groupBy("patient_id", "hadm_id", "config_name").agg(
        *[F.max(s).alias(s) for s in ("apache_ii_score", "sofa_score", "saps_ii_score", "oasis_score")]
    )
    unit = F.col("first_careunit") if "first_careunit" in stays.columns else F.lit(None).cast("string")
    per_stay = stays.select("hadm_id", "intime", "outtime", unit.alias("first_careunit")).join(admissions, "hadm_id")
    death = F.col("deathtime")
    stay_facts = per_stay.groupBy("hadm_id").agg(
        F.max(F.col("hospital_expire_flag") == 1).alias("hospital_mortality"),
        F.max(is_true((death >= F.col("intime")) & (death <= F.col("outtime")))).alias("icu_mortality"),
        F.max(is_true(death <= add_hours("admittime", 720))).alias("day_30_mortality"),
        F.min("admission_type").alias("admission_type"),
        F.min_by("first_careunit", "intime").alias("first_careunit"),
        (F.max(hours_between("admittime", "dischtime")) / 24).alias("los_hospital"),
        (F.sum(hours_between("intime", "outtime")) / 24).alias("los_icu"),
    )
    people = patients.select(F.col("subject_id").alias("patient_id"), "age", "gender")
    return best.join(stay_facts, "hadm_id").join(people, "patient_id", "left")


def multi_score_stays(df: DataFrame) -> DataFrame:
    """Rows of stays with more than one score."""
    several = df.groupBy("stay_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("stay_id")
    return df.join(several, "stay_id", "left_semi")


def trajectories(df: DataFrame) -> DataFrame:
    """Score course of stays with several scores, one row per point.

    Points stay rows: a course can be drawn from them in order, and no stay has
    to fit into one array.
    """
    return multi_score_stays(df).select("stay_id", "hours_from_admission", "total_sofa_score")
