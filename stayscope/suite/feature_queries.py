"""Labels, features, splits and their profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayscope.functions.bins import cut, equal_width_right_closed
from stayscope.functions.columns import round_to
from stayscope.operators import features, models, outcomes, stats
from stayscope.suite.registry import ORACLE, query
from stayscope.suite.sql_views import VIEWS
from stayscope.suite.stats_queries import rounded

VIEWS["cv_mort"] = """
    SELECT s.hadm_id, s.subject_id, s.stay_id, s.intime AS icu_intime, s.outtime AS icu_outtime, a.deathtime,
           CASE WHEN a.deathtime BETWEEN s.intime AND s.outtime + INTERVAL 48 HOUR THEN 1 ELSE 0 END AS mortality_48h
    FROM cv_stays s JOIN cv_adm a USING (hadm_id)"""
VIEWS["cv_lab48"] = """
    SELECT s.*, m.hadm_id, m.icu_intime, m.icu_outtime, m.deathtime, m.mortality_48h,
           (epoch_us(s.charttime) - epoch_us(m.icu_intime)) / 3.6e9 AS hours_from_admission,
           s.charttime + INTERVAL 48 HOUR AS prediction_timepoint,
           CASE WHEN m.deathtime <= s.charttime + INTERVAL 48 HOUR AND m.deathtime > s.charttime THEN 1 ELSE 0 END AS target_mortality_48h
    FROM cv_sofa s JOIN cv_mort m ON s.stay_id = m.stay_id
    WHERE (s.charttime <= m.icu_outtime - INTERVAL 48 HOUR OR (m.deathtime IS NOT NULL AND s.charttime <= m.deathtime - INTERVAL 2 HOUR))
      AND s.charttime >= m.icu_intime"""
KEY = "stay_id, charttime"


def labelled(x):
    return x.written("labelled", lambda: outcomes.time_aware_dataset(x.sofa, x.views.stays, x.views.admissions).drop("vasopressor_doses"))


def built(x):
    return x.written("features", lambda: features.build_features(labelled(x)))


@query("t7_j5_stay_mortality", "SELECT * FROM cv_mort")
def _(x):
    return outcomes.stay_mortality(x.views.stays, x.views.admissions)


@query(
    "t6_j6_time_aware_dataset",
    f"SELECT subject_id, {KEY}, total_sofa_score, mortality_48h, rnd(hours_from_admission, 6) AS hours_from_admission, prediction_timepoint, target_mortality_48h FROM cv_lab48",
)
def _(x):
    df = outcomes.time_aware_dataset(x.sofa, x.views.stays, x.views.admissions)
    return df.select("subject_id", "stay_id", "charttime", "total_sofa_score", "mortality_48h", round_to("hours_from_admission", 6).alias("hours_from_admission"), "prediction_timepoint", "target_mortality_48h")


PHASE = "CASE WHEN h > 0 AND h <= 24 THEN '0-24h' WHEN h > 24 AND h <= 48 THEN '24-48h' WHEN h > 48 AND h <= 72 THEN '48-72h' WHEN h > 72 THEN '>72h' END"


@query(
    "m1_temporal_features",
    f"""SELECT {KEY}, CAST(hour(charttime) AS INTEGER) AS hour_of_day, CAST((dayofweek(charttime) + 6) % 7 AS INTEGER) AS day_of_week,
               CASE WHEN dayofweek(charttime) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
               CASE WHEN hour(charttime) >= 19 OR hour(charttime) <= 7 THEN 1 ELSE 0 END AS is_night_shift, 240.0::DOUBLE AS icu_los_hours,
               rnd(240 - h, 6) AS remaining_icu_hours, CASE WHEN h <= 24 THEN 1 ELSE 0 END AS is_early_measurement,
               CASE WHEN h >= 72 THEN 1 ELSE 0 END AS is_late_measurement, {PHASE} AS admission_phase
        FROM (SELECT *, hours_from_admission AS h FROM cv_lab48)""",
)
def _(x):
    cols = ["hour_of_day", "day_of_week", "is_weekend", "is_night_shift", "icu_los_hours", "remaining_icu_hours", "is_early_measurement", "is_late_measurement", "admission_phase"]
    df = features.temporal_features(labelled(x)).select("stay_id", "charttime", *cols)
    return df.withColumn("remaining_icu_hours", round_to("remaining_icu_hours", 6))


COMP = features.COMPONENTS
GREATEST = f"greatest({', '.join(COMP)})"


@query(
    "m2_score_features",
    f"""SELECT {KEY}, {' + '.join(f'({c} > 0)::INT' for c in COMP)} AS sofa_components_affected, (total_sofa_score >= 10)::INT AS sofa_severity_high,
               (total_sofa_score BETWEEN 5 AND 9)::INT AS sofa_severity_moderate, (total_sofa_score BETWEEN 1 AND 4)::INT AS sofa_severity_mild,
               CASE WHEN {GREATEST} = 0 THEN NULL {' '.join(f"WHEN {c} = {GREATEST} THEN '{c}'" for c in COMP)} END AS dominant_organ_failure FROM cv_lab48""",
)
def _(x):
    return features.score_features(labelled(x)).select(
        "stay_id", "charttime", "sofa_components_affected", "sofa_severity_high", "sofa_severity_moderate", "sofa_severity_mild", "dominant_organ_failure"
    )


@query(
    "m3_clinical_features",
    f"""SELECT {KEY}, coalesce((mean_arterial_pressure < 65)::INT, 0) AS hypotensive, coalesce((mean_arterial_pressure > 100)::INT, 0) AS hypertensive,
               CASE WHEN creatinine_level > 0 AND creatinine_level <= 1.2 THEN 'normal' WHEN creatinine_level > 1.2 AND creatinine_level <= 2 THEN 'mild_aki'
                    WHEN creatinine_level > 2 AND creatinine_level <= 3 THEN 'moderate_aki' WHEN creatinine_level > 3 THEN 'severe_aki' END AS aki_stage,
               coalesce((bilirubin_level > 2)::INT, 0) AS hyperbilirubinemia, coalesce((platelet_count < 100)::INT, 0) AS thrombocytopenia,
               coalesce((platelet_count < 50)::INT, 0) AS severe_thrombocytopenia, coalesce((gcs_total < 15)::INT, 0) AS altered_consciousness,
               coalesce((gcs_total <= 8)::INT, 0) AS severe_altered_consciousness, coalesce((urine_output_24h < 400)::INT, 0) AS oliguria,
               coalesce((urine_output_24h < 100)::INT, 0) AS anuria FROM cv_lab48""",
)
def _(x):
    cols = ["hypotensive", "hypertensive", "aki_stage", "hyperbilirubinemia", "thrombocytopenia", "severe_thrombocytopenia", "altered_consciousness", "severe_altered_consciousness", "oliguria", "anuria"]
    return features.clinical_features(labelled(x)).select("stay_id", "charttime", *cols)


@query(
    "m4_interactions",
    f"""SELECT {KEY}, rnd(total_sofa_score * hours_from_admission, 5) AS sofa_time_interaction,
               rnd(data_completeness_score * total_sofa_score, 6) AS completeness_sofa_interaction, cardiovascular_score * renal_score AS cardio_renal_interaction FROM cv_lab48""",
)
def _(x):
    df = features.interactions(labelled(x)).select("stay_id", "charttime", "sofa_time_interaction", "completeness_sofa_interaction", "cardio_renal_interaction")
    return rounded(rounded(df, "sofa_time_interaction", digits=5), "completeness_sofa_interaction")


FILL = "last_value({c} IGNORE NULLS) OVER (PARTITION BY stay_id ORDER BY charttime ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(
    "t8_forward_fill",
    f"SELECT {KEY}, " + ", ".join(f"rnd({FILL.format(c=c)}, 6) AS {c}" for c in features.CARRIED) + " FROM cv_lab48",
)
def _(x):
    return rounded(features.forward_fill(labelled(x)).select("stay_id", "charttime", *features.CARRIED), *features.CARRIED)


@query(
    "m5_handle_missing",
    f"SELECT {KEY}, "
    + ", ".join(f"rnd(coalesce({FILL.format(c=c) if c in features.CARRIED else c}, {v}), 6) AS {c}" for c, v in features.NORMAL.items())
    + ", "
    + ", ".join(f"({c} IS NULL)::INT AS {c}_missing" for c in features.WATCHED)
    + " FROM cv_lab48",
)
def _(x):
    df = features.handle_missing(labelled(x), indicators="before")
    cols = list(features.NORMAL)
    return rounded(df.select("stay_id", "charttime", *cols, *[f"{c}_missing" for c in features.WATCHED]), *cols)


@query(
    "m6_encode",
    f"""WITH f AS (SELECT {KEY}, {PHASE} AS p,
               CASE WHEN creatinine_level > 0 AND creatinine_level <= 1.2 THEN 'normal' WHEN creatinine_level > 1.2 AND creatinine_level <= 2 THEN 'mild_aki'
                    WHEN creatinine_level > 2 AND creatinine_level <= 3 THEN 'moderate_aki' WHEN creatinine_level > 3 THEN 'severe_aki' END AS a,
               CASE WHEN {GREATEST} = 0 THEN NULL {' '.join(f"WHEN {c} = {GREATEST} THEN '{c}'" for c in COMP)} END AS d
               FROM (SELECT *, hours_from_admission AS h FROM cv_lab48))
        SELECT {KEY}, CASE WHEN p IS NOT NULL THEN (SELECT count(DISTINCT g.p) FROM f g WHERE g.p < f.p)::DOUBLE END AS admission_phase_encoded,
               CASE WHEN a IS NOT NULL THEN (SELECT count(DISTINCT g.a) FROM f g WHERE g.a < f.a)::DOUBLE END AS aki_stage_encoded,
               {', '.join(f"coalesce((d = '{c}')::INT, 0) AS dominant_organ_failure_{c}" for c in COMP)}, (d IS NULL)::INT AS dominant_organ_failure_nan FROM f""",
)
def _(x):
    return built(x).select("stay_id", "charttime", "admission_phase_encoded", "aki_stage_encoded", *[f"dominant_organ_failure_{c}" for c in COMP], "dominant_organ_failure_nan")


MEASURED = list(features.NORMAL)
DIGITS = {"sofa_time_interaction": 5, "hours_from_admission": 6, "data_completeness_score": 6}
LABELLED = [*COMP, "total_sofa_score", "hours_from_admission", "data_completeness_score", "target_mortality_48h"]
PARTS = ["m1_temporal_features", "m2_score_features", "m3_clinical_features", "m4_interactions", "m5_handle_missing", "m6_encode"]
ENCODED = ["admission_phase_encoded", "aki_stage_encoded", *[f"dominant_organ_failure_{c}" for c in (*COMP, "nan")]]


# The columns of the SQL of each step; marks set after filling find nothing missing
@query(
    "p17_selected_features",
    f"SELECT {KEY}, {', '.join(f'rnd(l.{c}, {DIGITS[c]}) AS {c}' if c in DIGITS else f'l.{c}' for c in LABELLED)}, "
    + ", ".join(f"m5.{c}" if c in MEASURED else c for c in features.WANTED if c not in LABELLED)
    + f", {', '.join(f'0 AS {c}_missing' for c in features.WATCHED)}, {', '.join(ENCODED)} FROM cv_lab48 l "
    + " ".join(f"JOIN ({ORACLE[part]}) {part[:2]} USING (stay_id, charttime)" for part in PARTS),
)
def _(x):
    df = built(x)
    cols = features.select_features(df)
    picked = df.select("stay_id", "charttime", *cols, "target_mortality_48h")
    picked = rounded(picked, *[c for c in MEASURED if c in cols], "hours_from_admission", "data_completeness_score", "completeness_sofa_interaction")
    return rounded(picked, "sofa_time_interaction", digits=5)


ORDER = "prediction_timepoint, subject_id, stay_id, charttime"
VIEWS["cv_split"] = f"""
    SELECT *, CASE WHEN n - r < n_test THEN 'test' WHEN n - r < n_test + n_val THEN 'val' ELSE 'train' END AS split
    FROM (SELECT *, CAST(floor(n * 0.2::DOUBLE) AS BIGINT) AS n_test, CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS n_val
          FROM (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS r, count(*) OVER () AS n FROM cv_lab48))"""


def split(x):
    return x.written("split", lambda: features.temporal_split(built(x)))


@query("t10_temporal_split", f"SELECT {KEY}, split FROM cv_split")
def _(x):
    return features.temporal_split(labelled(x)).select("stay_id", "charttime", "split")


@query(
    "t10_split_summary",
    """SELECT split, count(*) AS rows, rnd(avg(target_mortality_48h), 6) AS positive_rate, min(prediction_timepoint) AS from_time,
              max(prediction_timepoint) AS to_time FROM cv_split GROUP BY 1""",
)
def _(x):
    return rounded(features.split_summary(split(x), "target_mortality_48h"), "positive_rate")


@query(
    "t11_j12_trajectories",
    """SELECT stay_id, rnd(hours_from_admission, 6) AS hours_from_admission, total_sofa_score FROM cv_lab48
       WHERE stay_id IN (SELECT stay_id FROM cv_lab48 GROUP BY 1 HAVING count(*) > 1)""",
)
def _(x):
    return rounded(outcomes.trajectories(labelled(x)), "hours_from_admission")


@query(
    "a31_class_balance",
    """SELECT p AS positives, g AS negatives, rnd(greatest(p, g) / nullif(least(p, g), 0)::DOUBLE, 6) AS imbalance_ratio,
              CASE WHEN least(p, g) = 0 OR greatest(p, g) / least(p, g)::DOUBLE > 10 THEN 'severe' WHEN greatest(p, g) / least(p, g)::DOUBLE > 3 THEN 'moderate' ELSE 'mild' END AS severity,
              rnd(p * 100.0 / (p + g), 6) AS positive_percent
       FROM (SELECT count(*) FILTER (WHERE target_mortality_48h = 1) AS p, count(*) FILTER (WHERE target_mortality_48h = 0) AS g FROM cv_lab48)""",
)
def _(x):
    return rounded(stats.class_balance(labelled(x), "target_mortality_48h"), "imbalance_ratio", "positive_percent")


@query(
    "a34_rate_by_time_bin",
    f"""SELECT {PHASE.replace("WHEN h > 72 THEN '>72h'", "WHEN h > 72 AND h <= 168 THEN '72h-1w' WHEN h > 168 THEN '>1week'")} AS time_bin, count(*) AS n,
               rnd(avg(target_mortality_48h), 6) AS rate, rnd(avg(data_completeness_score), 6) AS completeness
        FROM (SELECT *, hours_from_admission AS h FROM cv_lab48) GROUP BY 1 HAVING time_bin IS NOT NULL""",
)
def _(x):
    bin_ = cut("hours_from_admission", [0, 24, 48, 72, 168, None], ["0-24h", "24-48h", "48-72h", "72h-1w", ">1week"])
    df = labelled(x).groupBy(bin_.alias("time_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("target_mortality_48h").alias("rate"), F.avg("data_completeness_score").alias("completeness")
    ).filter("time_bin IS NOT NULL")
    return rounded(df, "rate", "completeness")


@query(
    "a34_rate_by_equal_bins",
    """SELECT CAST(greatest(ceil((h - lo) / (hi - lo) * 10) - 1, 0) AS INTEGER) AS hours_bin, count(*) AS n, rnd(avg(y), 6) AS rate
       FROM (SELECT hours_from_admission AS h, target_mortality_48h AS y, min(hours_from_admission) OVER () AS lo, max(hours_from_admission) OVER () AS hi FROM cv_lab48)
       GROUP BY 1""",
)
def _(x):
    df = labelled(x)
    ends = df.agg(F.struct(F.min("hours_from_admission").alias("lo"), F.max("hours_from_admission").alias("hi"))).scalar()
    bin_ = equal_width_right_closed(F.col("hours_from_admission"), ends["lo"], ends["hi"], 10)
    out = df.groupBy(bin_.alias("hours_bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("target_mortality_48h").alias("rate"))
    return rounded(out, "rate")


CORR = ["total_sofa_score", *COMP, "hours_from_admission", "data_completeness_score"]


@query(
    "l3_s10_target_correlations",
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, rnd(corr({c}, target_mortality_48h), 5) AS r FROM cv_lab48" for c in CORR)
    + ") ORDER BY abs(r) DESC NULLS LAST, feature LIMIT 5",
)
def _(x):
    return rounded(stats.target_correlations(labelled(x), CORR, "target_mortality_48h", k=5), "r", digits=5)


@query(
    "l5_sample_rows",
    "SELECT stay_id, charttime, total_sofa_score FROM cv_lab48 ORDER BY md5(concat_ws('|', stay_id, charttime, 42)), stay_id, charttime LIMIT 50",
)
def _(x):
    return models.sample_rows(labelled(x), 50, ["stay_id", "charttime"]).select("stay_id", "charttime", "total_sofa_score")
