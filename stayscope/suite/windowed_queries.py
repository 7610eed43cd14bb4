"""Windows from admission, rule aggregation, imputation and the scores built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayscope.functions.columns import round_to, small_table
from stayscope.operators import extract, imputation, reports, validate, windows
from stayscope.plans import windowed_gold
from stayscope.suite.registry import query
from stayscope.suite.sql_views import VIEWS

# Fixed values: (parameter, concept, aggregation)
RULES = [
    ("pao2", 3000010, "min"), ("fio2", 3000004, "max"), ("spo2", 3000003, "min"), ("map", 3000000, "min"),
    ("platelets", 3000011, "min"), ("bilirubin", 3000012, "max"), ("gcs_total", 3000016, "mean"),
    ("creatinine", 3000008, "last"), ("urine_output_24h", 3000009, "sum"), ("norepinephrine_dose", 3000001, "max"),
    ("dopamine_dose", 3000017, "max"),
]
H = 86_400_000_000
VIEWS["cv_rules"] = f"SELECT * FROM (VALUES {', '.join(str(r) for r in RULES)}) t(parameter, concept_id, aggregation)"
VIEWS["cv_ev"] = "SELECT subject_id, stay_id, charttime, concept_id, concept_name, valuenum_std AS value, bronze_id FROM cv_silver"
VIEWS["cv_cohort"] = "SELECT DISTINCT subject_id FROM cv_dx WHERE icd_code IN ('J96.01', 'J80')"
VIEWS["cv_win"] = """
    SELECT subject_id, hadm_id, stay_id, intime, CAST(i + 1 AS INTEGER) AS window_number, CAST(i + 1 AS INTEGER) AS icu_day,
           intime + to_days(CAST(i AS INTEGER)) AS window_start, least(intime + to_days(CAST(i + 1 AS INTEGER)), outtime) AS window_end
    FROM (SELECT *, unnest(generate_series(0, CAST(ceil(epoch(outtime - intime) / 86400.0) AS BIGINT) - 1)) AS i FROM cv_stays)"""
VIEWS["cv_inwin"] = """
    SELECT e.*, w.window_number, w.window_start, w.window_end, w.icu_day FROM cv_ev e
    JOIN cv_win w ON w.subject_id = e.subject_id AND w.stay_id = e.stay_id AND e.charttime >= w.window_start AND e.charttime < w.window_end"""
VIEWS["cv_par"] = """
    SELECT e.subject_id, e.stay_id, e.window_number, r.parameter,
           CASE r.aggregation WHEN 'min' THEN min(value) WHEN 'max' THEN max(value) WHEN 'mean' THEN avg(value)
                WHEN 'sum' THEN sum(value) ELSE arg_max(value, (charttime, bronze_id)) END AS parameter_value
    FROM cv_inwin e JOIN cv_rules r USING (concept_id) WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4, r.aggregation"""
VIEWS["cv_med"] = """
    SELECT concept_id, concept_name, quantile_cont(value, 0.5) AS median_value FROM cv_ev
    WHERE value IS NOT NULL AND subject_id IN (SELECT subject_id FROM cv_cohort) GROUP BY 1, 2 HAVING count(*) >= 10"""
VIEWS["cv_kept"] = """
    SELECT w.*, n.measurements FROM cv_win w JOIN (SELECT subject_id, stay_id, window_number, count(*) AS measurements
    FROM cv_inwin GROUP BY 1, 2, 3) n USING (subject_id, stay_id, window_number)"""
VIEWS["cv_grid"] = """
    SELECT w.subject_id, w.stay_id, w.window_number, w.window_start, r.parameter, r.concept_id, p.parameter_value
    FROM cv_kept w CROSS JOIN cv_rules r
    LEFT JOIN cv_par p ON p.subject_id = w.subject_id AND p.stay_id = w.stay_id AND p.window_number = w.window_number
         AND p.parameter = r.parameter"""
VIEWS["cv_locf"] = """
    SELECT g.subject_id, g.stay_id, g.window_number, g.parameter, arg_max(e.value, (e.charttime, e.bronze_id)) AS locf_value
    FROM cv_grid g JOIN cv_ev e ON e.subject_id = g.subject_id AND e.stay_id = g.stay_id AND e.concept_id = g.concept_id
         AND e.charttime < g.window_start AND e.charttime >= g.window_start - INTERVAL 24 HOUR AND e.value IS NOT NULL
    WHERE g.parameter_value IS NULL GROUP BY 1, 2, 3, 4"""
VIEWS["cv_full"] = """
    SELECT g.subject_id, g.stay_id, g.window_number, g.parameter,
           coalesce(g.parameter_value, l.locf_value, m.median_value) AS v,
           g.parameter_value IS NULL AND coalesce(l.locf_value, m.median_value) IS NOT NULL AS imputed
    FROM cv_grid g LEFT JOIN cv_locf l USING (subject_id, stay_id, window_number, parameter)
    LEFT JOIN cv_med m ON m.concept_id = g.concept_id"""
VIEWS["cv_wide"] = (
    "SELECT subject_id, stay_id, window_number, "
    + ", ".join(f"max(v) FILTER (WHERE parameter = '{p}') AS {p}" for p, *_ in RULES)
    + ", "
    + ", ".join(
        f"coalesce(bool_or(imputed) FILTER (WHERE parameter = '{p}'), FALSE) AS {f}" for p, f in windowed_gold.FLAGS.items()
    )
    + " FROM cv_full GROUP BY 1, 2, 3"
)
FR = "CASE WHEN fio2 > 1 THEN fio2 / 100 ELSE fio2 END"
VIEWS["cv_g1sub"] = f"""
    SELECT *, coalesce(pr, sr) AS rr,
      CASE WHEN coalesce(pr, sr) IS NULL THEN NULL WHEN coalesce(pr, sr) >= 400 THEN 0 WHEN coalesce(pr, sr) >= 300 THEN 1
           WHEN coalesce(pr, sr) >= 100 THEN 2 ELSE 3 END AS s_resp,
      CASE WHEN map IS NULL THEN NULL WHEN map >= 70 THEN 0 ELSE 1 END AS s_card,
      CASE WHEN platelets IS NULL THEN NULL WHEN platelets >= 150 THEN 0 WHEN platelets >= 100 THEN 1 WHEN platelets >= 50 THEN 2
           WHEN platelets >= 20 THEN 3 ELSE 4 END AS s_coag,
      CASE WHEN bilirubin IS NULL THEN NULL WHEN bilirubin < 1.2 THEN 0 WHEN bilirubin BETWEEN 1.2 AND 1.9 THEN 1
           WHEN bilirubin BETWEEN 2.0 AND 5.9 THEN 2 WHEN bilirubin BETWEEN 6.0 AND 11.9 THEN 3 WHEN bilirubin >= 12 THEN 4 ELSE 0 END AS s_liver,
      CASE WHEN gcs_total IS NULL THEN NULL WHEN gcs_total = 15 THEN 0 WHEN gcs_total BETWEEN 13 AND 14 THEN 1
           WHEN gcs_total BETWEEN 10 AND 12 THEN 2 WHEN gcs_total BETWEEN 6 AND 9 THEN 3 WHEN gcs_total < 6 THEN 4 ELSE 0 END AS s_cns,
      CASE WHEN creatinine IS NULL AND urine_output_24h IS NULL THEN NULL ELSE greatest(
        CASE WHEN creatinine BETWEEN 1.2 AND 1.9 THEN 1 WHEN creatinine BETWEEN 2.0 AND 3.4 THEN 2
             WHEN creatinine BETWEEN 3.5 AND 4.9 THEN 3 WHEN creatinine >= 5 THEN 4 ELSE 0 END,
        CASE WHEN urine_output_24h < 200 THEN 4 WHEN urine_output_24h < 500 THEN 3 ELSE 0 END) END AS s_renal
    FROM (SELECT *, CASE WHEN {FR} > 0 THEN pao2 / ({FR}) END AS pr, CASE WHEN {FR} > 0 THEN spo2 / ({FR}) END AS sr FROM cv_wide)"""
VIEWS["cv_g1gold"] = """
    SELECT k.subject_id, k.hadm_id, k.stay_id, k.window_start, k.window_end, k.window_number, k.icu_day, s.* EXCLUDE (subject_id, stay_id, window_number),
      coalesce(s_resp, 0) + coalesce(s_card, 0) + coalesce(s_coag, 0) + coalesce(s_liver, 0) + coalesce(s_cns, 0) + coalesce(s_renal, 0) AS total,
      (s_resp IS NULL)::INT + (s_card IS NULL)::INT + (s_coag IS NULL)::INT + (s_liver IS NULL)::INT + (s_cns IS NULL)::INT + (s_renal IS NULL)::INT AS n_missing,
      CASE WHEN subject_id IN (SELECT subject_id FROM cv_cohort) THEN 'ARI' ELSE 'OTHER' END AS disease_type
    FROM cv_kept k JOIN cv_g1sub s USING (subject_id, stay_id, window_number)"""

# The same with all windows of a stay, those without an event included
VIEWS["cv_kept_all"] = VIEWS["cv_kept"].replace("SELECT w.*, n.measurements", "SELECT w.*, coalesce(n.measurements, 0) AS measurements").replace("cv_win w JOIN", "cv_win w LEFT JOIN")
_CHAIN = ["cv_kept", "cv_grid", "cv_locf", "cv_full", "cv_wide", "cv_g1sub", "cv_g1gold"]
for _name in _CHAIN[1:]:
    _sql = VIEWS[_name]
    for _old in _CHAIN:
        _sql = _sql.replace(f"{_old} ", f"{_old}_all ").replace(f"{_old})", f"{_old}_all)")
    VIEWS[f"{_name}_all"] = _sql

SETTINGS = windowed_gold.WindowSettings()


def rules(x):
    return small_table(x.spark, RULES, "parameter string, concept_id int, aggregation string")


def events(x):
    return x.silver.select(
        "subject_id", "stay_id", "charttime", "concept_id", "concept_name", F.col("valuenum_std").alias("value"), "bronze_id"
    )


def cohort(x):
    return extract.diagnosis_cohort(x.views.diagnoses, ["J96.01", "J80"]).select("subject_id").distinct()


def stay_windows(x):
    return windows.stay_windows(extract.eligible_stays(x.views.stays).drop("duration_hours"))


def placed(x):
    return windows.add_window_bounds(windows.events_in_windows(events(x), extract.eligible_stays(x.views.stays).drop("duration_hours")))


# The silver of this generation may still hold outliers; rates above a bound of their concept stand for them
RANGE = "concept_id IN (3000000, 3000003) AND value > 95"
VIEWS["cv_marked"] = f"SELECT *, coalesce({RANGE}, FALSE) AS is_outlier FROM cv_ev"


def marked(x):
    return events(x).withColumn("is_outlier", F.expr(f"coalesce({RANGE}, FALSE)"))


@query(
    "j11_events_without_outliers",
    """SELECT e.bronze_id, e.subject_id, e.stay_id, w.window_number FROM cv_marked e
       JOIN cv_win w ON w.subject_id = e.subject_id AND w.stay_id = e.stay_id AND e.charttime >= w.window_start AND e.charttime < w.window_end
       WHERE NOT e.is_outlier""",
)
def _(x):
    return windows.events_in_windows(marked(x), x.views.stays).select("bronze_id", "subject_id", "stay_id", "window_number")


@query(
    "a25_medians_without_outliers",
    """SELECT concept_id, concept_name, rnd(quantile_cont(value, 0.5), 6) AS median_value FROM cv_marked
       WHERE value IS NOT NULL AND NOT is_outlier AND subject_id IN (SELECT subject_id FROM cv_cohort) GROUP BY 1, 2 HAVING count(*) >= 10""",
)
def _(x):
    return imputation.population_medians(marked(x), cohort(x)).withColumn("median_value", round_to("median_value", 6))


def gold(x):
    return x.written("windowed_gold", lambda: gold_plan(x))


def gold_plan(x):
    return windowed_gold.windowed_scores(events(x), x.views.stays, rules(x), cohort(x), SETTINGS)


@query("c18_few_missing", "SELECT stay_id, window_number, CAST(n_missing AS INTEGER) AS n_missing FROM cv_g1gold WHERE n_missing <= 3")
def _(x):
    return windowed_gold.few_missing(gold(x), 3).select("stay_id", "window_number", F.size("missing_components").alias("n_missing"))


@query("t2_stay_windows", "SELECT * FROM cv_win")
def _(x):
    return stay_windows(x)


@query("j11_events_in_windows", "SELECT bronze_id, subject_id, stay_id, window_number, window_start, window_end FROM cv_inwin")
def _(x):
    return placed(x).select("bronze_id", "subject_id", "stay_id", "window_number", "window_start", "window_end")


@query("a26_aggregate_parameters", "SELECT subject_id, stay_id, window_number, parameter, rnd(parameter_value, 6) AS parameter_value FROM cv_par")
def _(x):
    return imputation.aggregate_parameters(placed(x), rules(x)).withColumn("parameter_value", round_to("parameter_value", 6))


@query("a25_population_medians", "SELECT concept_id, concept_name, rnd(median_value, 6) AS median_value FROM cv_med")
def _(x):
    return imputation.population_medians(events(x), cohort(x)).withColumn("median_value", round_to("median_value", 6))


@query(
    "j10_t9_locf",
    """SELECT g.subject_id, g.stay_id, g.window_number, g.parameter, rnd(l.locf_value, 6) AS locf_value
       FROM cv_grid g LEFT JOIN cv_locf l USING (subject_id, stay_id, window_number, parameter) WHERE g.parameter_value IS NULL""",
)
def _(x):
    sizes = placed(x).groupBy(*imputation.WINDOW).agg(F.count(F.lit(1)).alias("n")).drop("n")
    kept = stay_windows(x).join(sizes, imputation.WINDOW)
    listed = F.array(*[F.struct(F.lit(p).alias("parameter"), F.lit(c).alias("concept_id")) for p, c, _a in RULES])
    grid = kept.select(*imputation.WINDOW, "window_start", F.inline(listed))
    have = imputation.aggregate_parameters(placed(x), rules(x))
    gaps = grid.join(have, [*imputation.WINDOW, "parameter"], "left_anti")
    found = imputation.impute_locf(gaps, events(x))
    return found.select(*imputation.WINDOW, "parameter", round_to("locf_value", 6).alias("locf_value"))


G1_SHOWN = """subject_id, hadm_id, stay_id, window_start, window_end, window_number, icu_day, rnd(pao2, 4) AS pao2, rnd(fio2, 4) AS fio2,
 rnd(spo2, 4) AS spo2, rnd(map, 4) AS map, rnd(platelets, 4) AS platelets, rnd(bilirubin, 4) AS bilirubin, rnd(gcs_total, 4) AS gcs_total,
 rnd(creatinine, 4) AS creatinine, rnd(urine_output_24h, 4) AS urine_output_24h, rnd(pr, 4) AS pao2_fio2_ratio, rnd(sr, 4) AS spo2_fio2_ratio,
 pr IS NULL AND sr IS NOT NULL AS spo2_fio2_surrogate, map_imputed, platelets_imputed, bilirubin_imputed, gcs_imputed,
 creatinine_imputed, urine_output_imputed, s_resp AS sofa_respiratory_subscore, s_card AS sofa_cardiovascular_subscore,
 s_coag AS sofa_coagulation_subscore, s_liver AS sofa_liver_subscore, s_cns AS sofa_cns_subscore, s_renal AS sofa_renal_subscore,
 total AS sofa_total, n_missing AS missing_count, CASE WHEN total = 0 THEN 'Normal' WHEN total <= 6 THEN 'Mild' WHEN total <= 12 THEN 'Moderate'
 WHEN total <= 18 THEN 'Severe' ELSE 'Critical' END AS sofa_severity, disease_type"""
VALUES = ["pao2", "fio2", "spo2", "map", "platelets", "bilirubin", "gcs_total", "creatinine", "urine_output_24h", "pao2_fio2_ratio", "spo2_fio2_ratio"]


def shown(df):
    return (
        df
        .withColumns({c: round_to(c, 4) for c in VALUES})
        .withColumn("missing_count", F.size("missing_components"))
        .drop("missing_components", "calculation_notes", "intime", "measurements", "pao2_fio2_imputed", "is_mechanically_ventilated",
              "dopamine_dose", "epinephrine_dose", "norepinephrine_dose", "dobutamine_dose")
    )


@query("c17_windowed_scores", f"SELECT {G1_SHOWN} FROM cv_g1gold")
def _(x):
    return shown(gold_plan(x))


@query("c18_windows_without_events", f"SELECT {G1_SHOWN} FROM cv_g1gold_all")
def _(x):
    settings = windowed_gold.WindowSettings(min_measurements=0)
    return shown(windowed_gold.windowed_scores(events(x), x.views.stays, rules(x), cohort(x), settings))


@query(
    "c14_missing_and_notes",
    """SELECT stay_id, window_number, array_to_string([x FOR x IN [
          CASE WHEN s_resp IS NULL THEN 'respiratory' END, CASE WHEN s_card IS NULL THEN 'cardiovascular' END,
          CASE WHEN s_coag IS NULL THEN 'coagulation' END, CASE WHEN s_liver IS NULL THEN 'liver' END,
          CASE WHEN s_cns IS NULL THEN 'cns' END, CASE WHEN s_renal IS NULL THEN 'renal' END] IF x IS NOT NULL], ',') AS missing,
          concat_ws('; ',
            CASE WHEN rr >= 400 THEN 'Respiratory: PaO2/FiO2 ≥ 400' WHEN rr >= 300 THEN 'Respiratory: PaO2/FiO2 < 400'
                 WHEN rr >= 200 THEN 'Respiratory: PaO2/FiO2 < 300' WHEN rr >= 100 THEN 'Respiratory: PaO2/FiO2 < 200 without mechanical ventilation'
                 WHEN rr < 100 THEN 'Respiratory: PaO2/FiO2 < 100 without mechanical ventilation' END,
            CASE s_card WHEN 0 THEN 'Cardiovascular: MAP ≥ 70 mmHg' WHEN 1 THEN 'Cardiovascular: MAP < 70 mmHg' END,
            CASE s_coag WHEN 0 THEN 'Coagulation: Platelets ≥ 150 × 10³/μL' WHEN 1 THEN 'Coagulation: Platelets < 150 × 10³/μL'
                 WHEN 2 THEN 'Coagulation: Platelets < 100 × 10³/μL' WHEN 3 THEN 'Coagulation: Platelets < 50 × 10³/μL'
                 WHEN 4 THEN 'Coagulation: Platelets < 20 × 10³/μL' END,
            CASE WHEN bilirubin < 1.2 THEN 'Liver: Bilirubin < 1.2 mg/dL' WHEN s_liver = 0 THEN 'Liver: Normal liver function'
                 WHEN s_liver = 1 THEN 'Liver: Bilirubin 1.2-1.9 mg/dL' WHEN s_liver = 2 THEN 'Liver: Bilirubin 2.0-5.9 mg/dL'
                 WHEN s_liver = 3 THEN 'Liver: Bilirubin 6.0-11.9 mg/dL' WHEN s_liver = 4 THEN 'Liver: Bilirubin ≥ 12.0 mg/dL' END,
            CASE WHEN gcs_total = 15 THEN 'CNS: GCS = 15' WHEN s_cns = 0 THEN 'CNS: Normal neurological function'
                 WHEN s_cns = 1 THEN 'CNS: GCS 13-14' WHEN s_cns = 2 THEN 'CNS: GCS 10-12' WHEN s_cns = 3 THEN 'CNS: GCS 6-9'
                 WHEN s_cns = 4 THEN 'CNS: GCS < 6' END,
            CASE s_renal WHEN 0 THEN 'Renal: Normal renal function' WHEN 1 THEN 'Renal: Creatinine 1.2-1.9 mg/dL'
                 WHEN 2 THEN 'Renal: Creatinine 2.0-3.4 mg/dL' WHEN 3 THEN 'Renal: Creatinine 3.5-4.9 mg/dL or urine output < 500 mL/day'
                 WHEN 4 THEN 'Renal: Creatinine ≥ 5.0 mg/dL or urine output < 200 mL/day' END) AS notes
       FROM cv_g1gold""",
)
def _(x):
    return gold(x).select("stay_id", "window_number", F.array_join("missing_components", ",").alias("missing"), F.col("calculation_notes").alias("notes"))


@query(
    "a21_gold_summary",
    """SELECT count(*) AS total_windows, count(DISTINCT subject_id) AS unique_patients, count(DISTINCT stay_id) AS unique_stays,
              rnd(avg(total), 4) AS avg_sofa, min(total) AS min_sofa, max(total) AS max_sofa,
              count(CASE WHEN disease_type = 'ARI' THEN 1 END) AS ari_windows,
              count(CASE WHEN disease_type = 'OTHER' THEN 1 END) AS other_windows FROM cv_g1gold""",
)
def _(x):
    return reports.gold_summary(gold(x))


# Validators of the score table


@query(
    "v1_basic",
    """SELECT count(*) AS total_windows, count(DISTINCT subject_id) AS patients, count(DISTINCT stay_id) AS stays,
              count(DISTINCT hadm_id) AS admissions, min(window_start) AS earliest, max(window_end) AS latest,
              rnd(avg(icu_day), 4) AS avg_icu_day, max(icu_day) AS max_icu_day FROM cv_g1gold""",
)
def _(x):
    return validate.v_basic(gold(x))


SUBS = {"respiratory": "s_resp", "cardiovascular": "s_card", "coagulation": "s_coag", "liver": "s_liver", "cns": "s_cns", "renal": "s_renal"}


@query(
    "v2_ranges",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS column_name, min({c}) AS lowest, max({c}) AS highest, rnd(avg({c}), 4) AS average,
                   count(CASE WHEN {c} < 0 OR {c} > {top} THEN 1 END) AS out_of_range FROM cv_g1gold"""
        for n, c, top in [("sofa_total", "total", 24), *((f"sofa_{k}_subscore", v, 4) for k, v in SUBS.items())]
    ),
)
def _(x):
    return validate.v_ranges(gold(x))


@query("v3_consistency", "SELECT count(*) AS total_rows, count(*) AS consistent_rows, 100.0::DOUBLE AS consistency_rate FROM cv_g1gold")
def _(x):
    return validate.v_consistency(gold(x))


@query(
    "v4_imputation",
    " UNION ALL ".join(
        f"SELECT '{f}' AS flag, count(CASE WHEN {f} THEN 1 END) AS imputed, rnd(avg({f}::INT) * 100, 2) AS imputation_rate FROM cv_g1gold"
        for f in windowed_gold.FLAGS.values()
    ),
)
def _(x):
    return validate.v_imputation(gold(x), list(windowed_gold.FLAGS.values()))


@query(
    "v5_missing",
    "SELECT CAST(n_missing AS INTEGER) AS missing_count, count(*) AS windows, rnd(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percentage FROM cv_g1gold GROUP BY 1",
)
def _(x):
    return validate.v_missing(gold(x))


@query(
    "v5_t13_temporal",
    "SELECT count(*) AS total_windows, 0::BIGINT AS invalid_order, count(CASE WHEN icu_day <> window_number THEN 1 END) AS day_mismatch FROM cv_g1gold",
)
def _(x):
    return validate.v_temporal(gold(x))


@query(
    "v6_cohort",
    """SELECT disease_type, count(*) AS windows, count(DISTINCT subject_id) AS patients, rnd(avg(total), 4) AS avg_sofa,
              min(total) AS min_sofa, max(total) AS max_sofa FROM cv_g1gold GROUP BY 1""",
)
def _(x):
    return validate.v_cohort(gold(x))


@query(
    "v7_distributions",
    " UNION ALL ".join(
        f"SELECT '{c}' AS parameter, count({c}) AS n, rnd(avg({c}), 4) AS mean, rnd(stddev_samp({c}), 4) AS std FROM cv_g1gold"
        for c in ("platelets", "bilirubin", "creatinine", "map", "urine_output_24h")
    ),
)
def _(x):
    return validate.v_distributions(gold(x), ["platelets", "bilirubin", "creatinine", "map", "urine_output_24h"])
