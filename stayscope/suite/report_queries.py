"""Layer summaries and score reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayscope.operators import reports
from stayscope.suite.registry import query

SYS = ["respiratory", "cardiovascular", "hepatic", "coagulation", "renal", "neurological"]
CONV = "count(CASE WHEN converted THEN 1 END)"


@query("a7_count_by_system", "SELECT sofa_system, source_table, count(*) AS records FROM cv_bronze GROUP BY ALL")
def _(x):
    return reports.count_by(x.bronze, "sofa_system", "source_table")


@query(
    "a8_coverage_totals",
    """SELECT count(*) AS records, count(DISTINCT subject_id) AS patients, count(DISTINCT stay_id) AS stays,
              count(DISTINCT itemid) AS items FROM cv_bronze""",
)
def _(x):
    return reports.coverage_totals(x.bronze)


@query(
    "a9_coverage_by_system",
    """SELECT sofa_system, count(DISTINCT subject_id) AS patients, count(DISTINCT stay_id) AS stays,
              rnd(count(DISTINCT subject_id) * 100.0::DOUBLE / (SELECT count(DISTINCT subject_id) FROM cv_bronze), 2) AS patient_percent
       FROM cv_bronze GROUP BY sofa_system""",
)
def _(x):
    return reports.coverage_by_system(x.bronze)


@query(
    "a10_silver_by_system",
    "SELECT sofa_system, count(*) AS records, count(DISTINCT subject_id) AS patients FROM cv_silver GROUP BY 1",
)
def _(x):
    return reports.silver_by_system(x.silver)


@query(
    "a10_l2_top_concepts",
    "SELECT concept_name, count(*) AS records FROM cv_silver GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15",
)
def _(x):
    return reports.top_concepts(x.silver)


@query(
    "a11_layer_rates",
    f"""SELECT b.n AS bronze_records, b.q AS quality_records, s.n AS silver_records,
               rnd(b.q * 100.0::DOUBLE / b.n, 2) AS retention_rate, rnd(s.m * 100.0::DOUBLE / s.n, 2) AS mapping_rate,
               rnd(s.c * 100.0::DOUBLE / s.n, 2) AS conversion_rate, rnd(s.o * 100.0::DOUBLE / s.n, 2) AS outlier_rate
        FROM (SELECT count(*) AS n, count(*) FILTER (WHERE NOT is_outlier AND NOT is_suspicious) AS q FROM cv_bronze) b,
             (SELECT count(*) AS n, count(concept_id) AS m, {CONV} AS c, 0 AS o FROM cv_silver) s""",
)
def _(x):
    return reports.layer_rates(x.bronze, x.silver)


@query(
    "a14_patient_summaries",
    f"""SELECT subject_id, count(DISTINCT hadm_id) AS total_admissions, count(*) AS total_measurements,
               min(charttime) AS first_measurement, max(charttime) AS last_measurement,
               CAST(extract(day FROM max(charttime) - min(charttime)) AS BIGINT) AS measurement_span_days,
               count(DISTINCT itemid) AS unique_parameters,
               rnd(avg(CASE WHEN concept_name = 'Heart Rate' THEN valuenum_std END), 1) AS avg_heart_rate,
               rnd(avg(CASE WHEN concept_name = 'Respiratory Rate' THEN valuenum_std END), 1) AS avg_resp_rate,
               rnd(avg(CASE WHEN concept_name = 'Oxygen Saturation' THEN valuenum_std END), 1) AS avg_spo2,
               rnd(avg(CASE WHEN concept_name = 'Creatinine' THEN valuenum_std END), 2) AS avg_creatinine,
               rnd(avg(CASE WHEN concept_name = 'pH' THEN valuenum_std END), 2) AS avg_ph,
               rnd(avg(CASE WHEN concept_name = 'Lactate' THEN valuenum_std END), 2) AS avg_lactate,
               0::BIGINT AS outlier_count, {CONV} AS unit_conversions, 0.0::DOUBLE AS outlier_percentage,
               count(CASE WHEN source_table = 'chartevents' THEN 1 END) AS chart_measurements,
               count(CASE WHEN source_table = 'labevents' THEN 1 END) AS lab_measurements
        FROM cv_silver WHERE valuenum_std IS NOT NULL GROUP BY subject_id""",
)
def _(x):
    return reports.patient_summaries(x.silver)


@query(
    "a15_clinical_indicators",
    f"""SELECT concept_name, unit_std AS standard_unit, count(*) AS total_measurements,
               count(DISTINCT subject_id) AS unique_patients, count(DISTINCT hadm_id) AS unique_admissions,
               rnd(avg(valuenum_std), 3) AS mean_value, rnd(stddev_samp(valuenum_std), 3) AS std_deviation,
               rnd(min(valuenum_std), 3) AS min_value, rnd(max(valuenum_std), 3) AS max_value,
               rnd(quantile_cont(valuenum_std, 0.05), 3) AS p05, rnd(quantile_cont(valuenum_std, 0.25), 3) AS q25,
               rnd(quantile_cont(valuenum_std, 0.5), 3) AS median, rnd(quantile_cont(valuenum_std, 0.75), 3) AS q75,
               rnd(quantile_cont(valuenum_std, 0.95), 3) AS p95,
               0::BIGINT AS outlier_count, {CONV} AS unit_conversions, 0::BIGINT AS duplicates_resolved,
               0.0::DOUBLE AS outlier_percentage, rnd({CONV} * 100.0::DOUBLE / count(*), 2) AS conversion_percentage,
               min(charttime) AS earliest_measurement, max(charttime) AS latest_measurement,
               CAST(extract(day FROM max(charttime) - min(charttime)) AS BIGINT) AS measurement_span_days
        FROM cv_silver WHERE valuenum_std IS NOT NULL GROUP BY concept_name, unit_std""",
)
def _(x):
    return reports.clinical_indicators(x.silver)


@query(
    "a16_daily_trends",
    """SELECT CAST(charttime AS DATE) AS measurement_date, concept_name, count(*) AS daily_measurements,
              count(DISTINCT subject_id) AS unique_patients, rnd(avg(valuenum_std), 3) AS daily_avg,
              rnd(stddev_samp(valuenum_std), 3) AS daily_std, rnd(min(valuenum_std), 3) AS daily_min,
              rnd(max(valuenum_std), 3) AS daily_max, 0::BIGINT AS daily_outliers
       FROM cv_silver WHERE valuenum_std IS NOT NULL GROUP BY 1, 2""",
)
def _(x):
    return reports.daily_trends(x.silver)


@query(
    "a17_hourly_patterns",
    """SELECT CAST(hour(charttime) AS INTEGER) AS measurement_hour, concept_name, count(*) AS hourly_measurements,
              rnd(avg(valuenum_std), 3) AS hourly_avg, rnd(stddev_samp(valuenum_std), 3) AS hourly_std
       FROM cv_silver WHERE valuenum_std IS NOT NULL GROUP BY 1, 2""",
)
def _(x):
    return reports.hourly_patterns(x.silver)


@query(
    "d4_quality_summary",
    f"""SELECT 'Silver Layer Overview' AS metric_category, 'Total Records' AS metric_name, CAST(count(*) AS VARCHAR) AS metric_value, 'records' AS unit FROM cv_silver
        UNION ALL SELECT 'Silver Layer Overview', 'Unique Patients', CAST(count(DISTINCT subject_id) AS VARCHAR), 'patients' FROM cv_silver
        UNION ALL SELECT 'Silver Layer Overview', 'Unique Parameters', CAST(count(DISTINCT concept_name) AS VARCHAR), 'parameters' FROM cv_silver
        UNION ALL SELECT 'Data Quality', 'Outliers Detected', '0', 'records'
        UNION ALL SELECT 'Data Quality', 'Unit Conversions', CAST({CONV} AS VARCHAR), 'records' FROM cv_silver
        UNION ALL SELECT 'Data Quality', 'Duplicates Resolved', '0', 'records'""",
)
def _(x):
    return reports.quality_summary(x.silver)


AVGS = ", ".join(f"rnd(avg({s}_score), 2) AS avg_{s}" for s in SYS)


@query(
    "a18_patient_sofa_summary",
    f"""SELECT subject_id, count(DISTINCT stay_id) AS total_stays, count(*) AS total_measurements,
               min(charttime) AS first_measurement, max(charttime) AS last_measurement, min(total_sofa_score) AS min_sofa,
               max(total_sofa_score) AS max_sofa, rnd(avg(total_sofa_score), 2) AS avg_sofa, {AVGS},
               rnd(avg(data_completeness_score), 2) AS avg_completeness FROM cv_sofa GROUP BY subject_id""",
)
def _(x):
    return reports.patient_sofa_summary(x.sofa)


@query(
    "a19_daily_sofa_trends",
    """SELECT CAST(charttime AS DATE) AS measurement_date, count(DISTINCT subject_id) AS unique_patients,
              count(*) AS total_scores, rnd(avg(total_sofa_score), 2) AS avg_total_sofa,
              min(total_sofa_score) AS min_total_sofa, max(total_sofa_score) AS max_total_sofa,
              count(CASE WHEN total_sofa_score >= 10 THEN 1 END) AS high_risk_count,
              rnd(100.0::DOUBLE * count(CASE WHEN total_sofa_score >= 10 THEN 1 END) / count(*), 2) AS high_risk_percentage,
              rnd(avg(respiratory_score), 2) AS avg_respiratory, rnd(avg(cardiovascular_score), 2) AS avg_cardiovascular,
              rnd(avg(renal_score), 2) AS avg_renal, rnd(avg(neurological_score), 2) AS avg_neurological
       FROM cv_sofa GROUP BY 1""",
)
def _(x):
    return reports.daily_sofa_trends(x.sofa)


@query(
    "a20_sofa_report",
    f"""SELECT count(*) AS total_scores, count(DISTINCT subject_id) AS unique_patients,
               rnd(avg(total_sofa_score), 2) AS avg_sofa, rnd(avg(data_completeness_score), 4) AS avg_completeness,
               count(CASE WHEN total_sofa_score >= 10 THEN 1 END) AS high_risk_count,
               rnd(100.0::DOUBLE * count(CASE WHEN total_sofa_score >= 10 THEN 1 END) / count(*), 2) AS high_risk_percentage,
               {AVGS} FROM cv_sofa""",
)
def _(x):
    return reports.sofa_report(x.sofa)


@query(
    "a22_t12_severity_histogram",
    """SELECT CASE WHEN total_sofa_score = 0 THEN '0 (Normal)' WHEN total_sofa_score <= 6 THEN '1-6 (Mild)'
                   WHEN total_sofa_score <= 9 THEN '7-9 (Moderate)' WHEN total_sofa_score <= 12 THEN '10-12 (Severe)'
                   ELSE '13+ (Critical)' END AS severity_range, count(*) AS n,
              rnd(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percentage
       FROM cv_sofa GROUP BY 1""",
)
def _(x):
    return reports.severity_histogram(x.sofa)


@query(
    "a23_availability",
    "SELECT "
    + ", ".join(f"rnd(avg({s}_data_available::INT) * 100, 2) AS {s}_percent" for s in SYS)
    + ", rnd(count(CASE WHEN data_completeness_score >= 0.8 THEN 1 END) * 100.0::DOUBLE / count(*), 2) AS complete_percent FROM cv_sofa",
)
def _(x):
    return reports.availability(x.sofa)


@query(
    "a24_score_range",
    """SELECT count(*) AS scores, count(DISTINCT subject_id) AS patients, count(DISTINCT stay_id) AS stays,
              min(total_sofa_score) AS min_score, max(total_sofa_score) AS max_score,
              rnd(avg(total_sofa_score), 2) AS avg_score, 24.0::DOUBLE AS avg_window_hours,
              (SELECT count(*) FROM (SELECT subject_id FROM cv_sofa GROUP BY 1 HAVING max(total_sofa_score) >= 10)) AS high_risk_patients
       FROM cv_sofa""",
)
def _(x):
    return reports.score_range(x.sofa)


@query(
    "a35_assess_layers",
    """SELECT b.sofa_system, b.items, s.silver_records, s.concepts,
              CASE WHEN (SELECT count(DISTINCT sofa_system) FROM cv_bronze) >= 4 THEN 'GOOD' ELSE 'FAIR' END AS overall_assessment
       FROM (SELECT sofa_system, count(DISTINCT itemid) AS items FROM cv_bronze GROUP BY 1) b
       LEFT JOIN (SELECT sofa_system, count(*) AS silver_records, count(DISTINCT concept_id) AS concepts FROM cv_silver GROUP BY 1) s
       USING (sofa_system)""",
)
def _(x):
    return reports.assess_layers(x.bronze, x.silver)


@query(
    "a36_profile_table",
    """SELECT count(*) AS row_count, count(DISTINCT subject_id) AS distinct_subject_id,
              count(DISTINCT hadm_id) AS distinct_hadm_id, count(DISTINCT stay_id) AS distinct_stay_id,
              count(DISTINCT itemid) AS distinct_itemid,
              count(CASE WHEN is_sofa_parameter THEN 1 END) AS true_is_sofa_parameter,
              count(CASE WHEN is_outlier THEN 1 END) AS true_is_outlier,
              count(CASE WHEN is_suspicious THEN 1 END) AS true_is_suspicious, 0::BIGINT AS true_has_unit_conversion
       FROM cv_bronze""",
)
def _(x):
    return reports.profile_table(x.bronze)


@query(
    "a36_l4_sample_row",
    "SELECT id, subject_id, stay_id, itemid, charttime, label, valuenum, valueuom, source_table FROM cv_bronze ORDER BY id LIMIT 1",
)
def _(x):
    return reports.sample_row(x.bronze, "id").select("id", "subject_id", "stay_id", "itemid", "charttime", "label", "valuenum", "valueuom", "source_table")


@query(
    "a33_describe_scores",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS n, rnd(avg({c}), 4) AS mean, rnd(stddev_samp({c}), 4) AS std,
                   CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25)::DOUBLE AS q25, quantile_cont({c}, 0.5)::DOUBLE AS median,
                   quantile_cont({c}, 0.75)::DOUBLE AS q75, CAST(max({c}) AS DOUBLE) AS max FROM cv_sofa"""
        for c in [*(f"{s}_score" for s in SYS), "total_sofa_score"]
    ),
)
def _(x):
    return reports.describe_scores(x.sofa, [*(f"{s}_score" for s in SYS), "total_sofa_score"])


MISSING = ["pao2_fio2_ratio", "mean_arterial_pressure", "bilirubin_level", "platelet_count", "creatinine_level", "urine_output_24h", "gcs_total"]


@query(
    "a32_missing_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count,
                   rnd((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_percent,
                   (count(*) - count({c})) * 100.0::DOUBLE / count(*) > 30 AS mostly_missing FROM cv_sofa"""
        for c in MISSING
    ),
)
def _(x):
    return reports.missing_profile(x.sofa, MISSING)
