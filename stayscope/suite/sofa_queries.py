"""Daily organ-failure scores and what is reported from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayscope.functions import sofa_rules
from stayscope.functions.columns import round_to
from stayscope.operators import windows
from stayscope.plans import sofa
from stayscope.suite.registry import query
from stayscope.suite.sql_views import VIEWS

SOFA_SHOWN = """subject_id, stay_id, charttime, window_start, window_end, respiratory_score, cardiovascular_score,
 hepatic_score, coagulation_score, renal_score, neurological_score, total_sofa_score,
 rnd(pao2_fio2_ratio, 4) AS pao2_fio2_ratio, rnd(mean_arterial_pressure, 4) AS mean_arterial_pressure,
 rnd(bilirubin_level, 4) AS bilirubin_level, rnd(platelet_count, 4) AS platelet_count,
 rnd(creatinine_level, 4) AS creatinine_level, rnd(urine_output_24h, 4) AS urine_output_24h,
 gcs_total, ventilated, respiratory_data_available, cardiovascular_data_available, hepatic_data_available,
 coagulation_data_available, renal_data_available, neurological_data_available,
 rnd(data_completeness_score, 6) AS data_completeness_score"""


@query("c7_sofa_scores_enhanced", f"SELECT {SOFA_SHOWN} FROM cv_sofa")
def _(x):
    rounded = {
        c: round_to(c, 4)
        for c in ("pao2_fio2_ratio", "mean_arterial_pressure", "bilirubin_level", "platelet_count", "creatinine_level", "urine_output_24h")
    }
    return x.sofa_plan.drop("vasopressor_doses").withColumns(
        {**rounded, "data_completeness_score": round_to("data_completeness_score", 6)}
    )


@query(
    "t1_daily_windows",
    "SELECT bronze_id, window_end - INTERVAL 24 HOUR AS window_start, window_end FROM cv_daily",
)
def _(x):
    rows = x.silver.filter("valuenum_std IS NOT NULL").select("bronze_id", "subject_id", "stay_id", "charttime")
    return windows.daily_windows(rows).select("bronze_id", "window_start", "window_end")


@query(
    "t4_latest_by_concept",
    """SELECT stay_id, window_end, lower(concept_name) AS concept, rnd(arg_max(valuenum_std, (charttime, bronze_id)), 6) AS last_value, count(*) AS value_count
       FROM cv_daily GROUP BY 1, 2, 3""",
)
def _(x):
    rows = windows.daily_windows(x.silver.filter("valuenum_std IS NOT NULL"))
    latest = windows.latest_by_concept(rows, ["stay_id", "window_end"])
    return latest.select("stay_id", "window_end", "concept", round_to("last_value", 6).alias("last_value"), "value_count")


@query(
    "t5_vasopressor_doses",
    "SELECT stay_id, charttime, rnd(dopamine, 6) AS dopamine, rnd(norepinephrine, 6) AS norepinephrine FROM cv_sofa",
)
def _(x):
    def dose(n):
        return round_to(F.try_element_at("vasopressor_doses", F.lit(n)), 6).alias(n)

    return x.sofa.select("stay_id", "charttime", dose("dopamine"), dose("norepinephrine"))


VIEWS["cv_table"] = """
    SELECT *, coalesce(r, 0) + coalesce(c, 0) + coalesce(l, 0) + coalesce(k, 0) + coalesce(u, 0) + coalesce(g, 0) AS total FROM (
    SELECT stay_id, charttime,
      CASE WHEN pao2_fio2_ratio >= 400 THEN 0 WHEN pao2_fio2_ratio >= 300 THEN 1 WHEN pao2_fio2_ratio >= 200 THEN 2
           WHEN pao2_fio2_ratio >= 100 THEN CASE WHEN ventilated THEN 3 ELSE 2 END
           WHEN pao2_fio2_ratio < 100 THEN CASE WHEN ventilated THEN 4 ELSE 3 END END AS r,
      CASE WHEN mean_arterial_pressure IS NULL AND coalesce(dopamine, 0) = 0 AND coalesce(norepinephrine, 0) = 0 THEN NULL
           WHEN dopamine > 15 OR norepinephrine > 0.1 THEN 4 WHEN dopamine > 5 OR (norepinephrine > 0 AND norepinephrine <= 0.1) THEN 3
           WHEN dopamine > 0 AND dopamine <= 5 THEN 2 WHEN mean_arterial_pressure < 70 THEN 1 ELSE 0 END AS c,
      CASE WHEN bilirubin_level IS NULL THEN NULL WHEN bilirubin_level BETWEEN 1.2 AND 1.9 THEN 1 WHEN bilirubin_level BETWEEN 2 AND 5.9 THEN 2
           WHEN bilirubin_level BETWEEN 6 AND 11.9 THEN 3 WHEN bilirubin_level >= 12 THEN 4 ELSE 0 END AS l,
      CASE WHEN platelet_count >= 150 THEN 0 WHEN platelet_count >= 100 THEN 1 WHEN platelet_count >= 50 THEN 2 WHEN platelet_count >= 20 THEN 3
           WHEN platelet_count < 20 THEN 4 END AS k,
      CASE WHEN creatinine_level IS NULL AND urine_output_24h IS NULL THEN NULL ELSE greatest(
        CASE WHEN creatinine_level BETWEEN 1.2 AND 1.9 THEN 1 WHEN creatinine_level BETWEEN 2.0 AND 3.4 THEN 2
             WHEN creatinine_level BETWEEN 3.5 AND 4.9 THEN 3 WHEN creatinine_level >= 5 THEN 4 ELSE 0 END,
        CASE WHEN urine_output_24h < 200 THEN 4 WHEN urine_output_24h < 500 THEN 3 ELSE 0 END) END AS u,
      CASE WHEN gcs_total IS NULL THEN NULL WHEN gcs_total = 15 THEN 0 WHEN gcs_total BETWEEN 13 AND 14 THEN 1 WHEN gcs_total BETWEEN 10 AND 12 THEN 2
           WHEN gcs_total BETWEEN 6 AND 9 THEN 3 WHEN gcs_total < 6 THEN 4 ELSE 0 END AS g
    FROM cv_sofa)"""


@query(
    "c8_c13_table_rule_set",
    """SELECT stay_id, charttime, r AS respiratory_score, c AS cardiovascular_score, l AS hepatic_score, k AS coagulation_score, u AS renal_score,
              g AS neurological_score, total AS total_sofa_score FROM cv_table""",
)
def _(x):
    return x.sofa_by_table.select("stay_id", "charttime", *[f"{s}_score" for s in sofa.SYSTEMS], "total_sofa_score")


@query(
    "c15_severity",
    """SELECT CASE WHEN total = 0 THEN 'Normal' WHEN total <= 6 THEN 'Mild' WHEN total <= 12 THEN 'Moderate' WHEN total <= 18 THEN 'Severe' ELSE 'Critical' END AS severity,
              count(*) AS n FROM cv_table GROUP BY 1""",
)
def _(x):
    return x.sofa_by_table.groupBy(sofa_rules.severity(F.col("total_sofa_score")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))
