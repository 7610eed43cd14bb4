"""Model features from labelled score rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayscope.functions.bins import cut
from stayscope.functions.columns import flag, hours_between
from stayscope.operators.ordered import carry_forward, global_positions

COMPONENTS = ["respiratory_score", "cardiovascular_score", "hepatic_score", "coagulation_score", "renal_score", "neurological_score"]
# Values taken as normal where a measurement is missing
NORMAL = {
    "pao2_fio2_ratio": 400.0, "mean_arterial_pressure": 85.0, "bilirubin_level": 1.0, "platelet_count": 250.0,
    "creatinine_level": 1.0, "urine_output_24h": 1500.0, "gcs_total": 15.0,
}
CARRIED = ["mean_arterial_pressure", "creatinine_level", "platelet_count"]
WATCHED = ["bilirubin_level", "gcs_total", "urine_output_24h"]
PHASES = ["0-24h", "24-48h", "48-72h", ">72h"]
STAGES = ["normal", "mild_aki", "moderate_aki", "severe_aki"]


def temporal_features(df: DataFrame) -> DataFrame:
    hour, day = F.hour("charttime"), F.weekday("charttime")
    since = F.col("hours_from_admission")
    return df.withColumns(
        {
            "hour_of_day": hour,
            "day_of_week": day,
            "is_weekend": flag(day.isin(5, 6)),
            "is_night_shift": flag((hour >= 19) | (hour <= 7)),
            "icu_los_hours": hours_between("icu_intime", "icu_outtime"),
            "remaining_icu_hours": hours_between("charttime", "icu_outtime"),
            "is_early_measurement": flag(since <= 24),
            "is_late_measurement": flag(since >= 72),
            "admission_phase": cut(since, [0, 24, 48, 72, None], PHASES),
        }
    )


def score_features(df: DataFrame) -> DataFrame:
    total = F.col("total_sofa_score")
    affected = sum((flag(F.col(c) > 0) for c in COMPONENTS), F.lit(0))
    top = F.greatest(*[F.col(c) for c in COMPONENTS])
    dominant = F.when(F.lit(False), F.lit(""))
    for c in COMPONENTS:
        dominant = dominant.when((F.col(c) == top) & (F.col(c) > 0), c)
    return df.withColumns(
        {
            "sofa_components_affected": affected,
            "sofa_severity_high": flag(total >= 10),
            "sofa_severity_moderate": flag((total >= 5) & (total < 10)),
            "sofa_severity_mild": flag((total >= 1) & (total < 5)),
            "dominant_organ_failure": dominant,
        }
    )


def clinical_features(df: DataFrame) -> DataFrame:
    """Threshold flags; a missing value raises none."""
    c = F.col
    return df.withColumns(
        {
            "hypotensive": flag(c("mean_arterial_pressure") < 65),
            "hypertensive": flag(c("mean_arterial_pressure") > 100),
            "aki_stage": cut("creatinine_level", [0, 1.2, 2.0, 3.0, None], STAGES),
            "hyperbilirubinemia": flag(c("bilirubin_level") > 2.0),
            "thrombocytopenia": flag(c("platelet_count") < 100),
            "severe_thrombocytopenia": flag(c("platelet_count") < 50),
            "altered_consciousness": flag(c("gcs_total") < 15),
            "severe_altered_consciousness": flag(c("gcs_total") <= 8),
            "oliguria": flag(c("urine_output_24h") < 400),
            "anuria": flag(c("urine_output_24h") < 100),
        }
    )


def interactions(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "sofa_time_interaction": F.col("total_sofa_score") * F.col("hours_from_admission"),
            "completeness_sofa_interaction": F.col("data_completeness_score") * F.col("total_sofa_score"),
            "cardio_renal_interaction": F.col("cardiovascular_score") * F.col("renal_score"),
        }
    )


def forward_fill(df: DataFrame, cols: Sequence[str] = CARRIED) -> DataFrame:
    """Latest earlier value within the stay."""
    return carry_forward(df, ["stay_id"], ["charttime"], "charttime", cols)


def handle_missing(df: DataFrame, indicators: str = "after") -> DataFrame:
    """Forward fill, then normal values, with missing indicators.

    ``indicators="after"`` marks what is still missing after filling, which is
    nothing; ``"before"`` marks what was missing in the data.
    """
    marks = {f"{c}_missing": F.col(c).isNull().cast("int") for c in WATCHED}
    rows = df.withColumns(marks) if indicators == "before" else df
    rows = forward_fill(rows).fillna(NORMAL)
    return rows.withColumns(marks) if indicators == "after" else rows


def encode(df: DataFrame) -> DataFrame:
    """Ordinal codes by alphabetical label order, and 0/1 columns for the dominant organ.

    Only labels that occur get a code, as an encoder fitted on the data gives.
    """

    def code(c: str) -> tuple[str, Column]:
        seen = df.agg(F.array_sort(F.collect_set(c))).scalar()  # at most as many as there are labels
        return f"{c}_encoded", F.when(F.col(c).isNotNull(), F.array_position(seen, F.col(c)).cast("double") - 1)

    hot = {f"dominant_organ_failure_{c}": flag(F.col("dominant_organ_failure") == c) for c in COMPONENTS}
    hot["dominant_organ_failure_nan"] = F.col("dominant_organ_failure").isNull().cast("int")
    return df.withColumns({**dict([code("admission_phase"), code("aki_stage")]), **hot})


def build_features(labelled: DataFrame, indicators: str = "after") -> DataFrame:
    rows = interactions(clinical_features(score_features(temporal_features(labelled))))
    return encode(handle_missing(rows, indicators))


# Wanted model inputs
WANTED = [
    *COMPONENTS, "total_sofa_score", "mean_arterial_pressure", "bilirubin_level", "platelet_count", "creatinine_level",
    "urine_output_24h", "gcs_total", "hours_from_admission", "hour_of_day", "day_of_week", "is_weekend",
    "is_night_shift", "is_early_measurement", "is_late_measurement", "sofa_components_affected", "sofa_severity_high",
    "sofa_severity_moderate", "hypotensive", "hypertensive", "thrombocytopenia", "altered_consciousness", "oliguria",
    "data_completeness_score", "sofa_time_interaction", "completeness_sofa_interaction", "cardio_renal_interaction",
]


def select_features(df: DataFrame) -> list[str]:
    """Wanted columns that exist, then the indicator, code and one-hot families."""
    families = [c for c in df.columns if c.endswith("_missing")]
    families += [c for c in df.columns if c.endswith("_encoded")]
    families += [c for c in df.columns if c.startswith("dominant_organ_failure_")]
    return [c for c in WANTED if c in df.columns] + families


def temporal_split(df: DataFrame, order: Sequence[str] = ("prediction_timepoint", "subject_id", "stay_id", "charttime"), test: float = 0.2, val: float = 0.1) -> DataFrame:
    """``split`` by position in time: the latest rows test, those before validate."""
    numbered = global_positions(df, order, "_position")
    total = numbered.agg(F.count(F.lit(1))).scalar()
    placed = numbered.withColumn("_total", total)
    n_test, n_val = (F.col("_total") * test).cast("bigint"), (F.col("_total") * val).cast("bigint")
    from_end = F.col("_total") - F.col("_position")
    split = F.when(from_end < n_test, "test").when(from_end < n_test + n_val, "val").otherwise("train")
    return placed.withColumn("split", split).drop("_position", "_total")


def split_summary(df: DataFrame, y: str) -> DataFrame:
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.col(y).cast("double")).alias("positive_rate"),
        F.min("prediction_timepoint").alias("from_time"), F.max("prediction_timepoint").alias("to_time"),
    )
