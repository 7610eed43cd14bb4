"""Policy runs and what they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayscope.functions.columns import round_to
from stayscope.operators import windows
from stayscope.plans import policies
from stayscope.suite.registry import query
from stayscope.suite.sql_views import VIEWS, expand_rnd

HOUR = 3_600_000_000
VIEWS["cv_pin"] = "SELECT subject_id, hadm_id, stay_id, charttime, concept_name, valuenum_std AS value, bronze_id FROM cv_silver WHERE valuenum_std IS NOT NULL"
for hours in (24, 12):
    VIEWS[f"cv_bins{hours}"] = f"""
        SELECT * EXCLUDE (off, span),
               CASE WHEN (span + {HOUR}) // {hours * HOUR} >= 1 AND off <= ((span + {HOUR}) // {hours * HOUR}) * {hours * HOUR}
                    THEN CAST(greatest(CAST(ceil(off / {float(hours * HOUR)}::DOUBLE) AS BIGINT) - 1, 0) AS INTEGER) END AS time_window
        FROM (SELECT *, epoch_us(charttime) - min(epoch_us(charttime)) OVER w AS off,
                     max(epoch_us(charttime)) OVER w - min(epoch_us(charttime)) OVER w AS span
              FROM cv_pin WINDOW w AS (PARTITION BY subject_id, stay_id))"""
VIEWS["cv_iqr"] = """
    SELECT b.* FROM cv_bins24 b LEFT JOIN (SELECT concept_name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
        FROM cv_bins24 GROUP BY 1) q USING (concept_name)
    WHERE NOT coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), FALSE)"""
VIEWS["cv_band"] = """
    SELECT b.* FROM cv_bins12 b LEFT JOIN (SELECT concept_name, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi
        FROM cv_bins12 GROUP BY 1) q USING (concept_name)
    WHERE NOT coalesce(value < lo OR value > hi, FALSE)"""
VIEWS["cv_pmean"] = """
    SELECT subject_id, hadm_id, stay_id, time_window, concept_name, avg(value) AS value,
           make_timestamp(CAST(sum(epoch_us(charttime)) // count(*) AS BIGINT)) AS charttime FROM cv_iqr
    WHERE time_window IS NOT NULL AND subject_id IS NOT NULL AND hadm_id IS NOT NULL AND stay_id IS NOT NULL AND concept_name IS NOT NULL
    GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 2"""
VIEWS["cv_pmedian"] = """
    SELECT subject_id, hadm_id, stay_id, time_window, concept_name, quantile_cont(value, 0.5) AS value,
           make_timestamp(CAST(floor(quantile_cont(CAST(epoch_us(charttime) AS DOUBLE), 0.5)) AS BIGINT)) AS charttime FROM cv_band
    WHERE time_window IS NOT NULL AND hadm_id IS NOT NULL AND stay_id IS NOT NULL AND concept_name IS NOT NULL
    GROUP BY 1, 2, 3, 4, 5 HAVING count(*) >= 3"""
COLS = list(policies.PARAMETERS.values())
for src in ("mean", "median"):
    VIEWS[f"cv_pv{src}"] = (
        "SELECT subject_id, hadm_id, stay_id, charttime, "
        + ", ".join(f"min(CASE WHEN concept_name = '{k}' THEN value END) AS {c}" for k, c in policies.PARAMETERS.items())
        + f" FROM cv_p{src} GROUP BY 1, 2, 3, 4"
    )
    fill = "avg({c}) OVER ()" if src == "mean" else "(SELECT quantile_cont({c}, 0.5) FROM cv_pvmedian)"
    VIEWS[f"cv_pi{src}"] = (
        "SELECT subject_id, hadm_id, stay_id, charttime, "
        + ", ".join(f"coalesce({c}, {fill.format(c=c)}) AS {c}" for c in COLS)
        + f" FROM cv_pv{src}"
    )


def case(c, steps):
    return "CASE " + " ".join(f"WHEN {c} > {b} THEN {p}" for b, p in steps) + " ELSE 0 END"


RR, HR, CR = "respiratory_rate", "heart_rate", "creatinine"
FULL = f"""{case('paco2', [(50, 3)])} + {case(HR, [(150, 3), (110, 2)])} + {case(CR, [(3.5, 4), (2, 3)])} AS apache_ii_score,
 {case(RR, [(30, 2), (25, 1)])} + {case(HR, [(120, 2)])} + {case(CR, [(5, 4), (3.5, 3), (2, 2), (1.2, 1)])} AS sofa_score,
 {case(HR, [(160, 7), (120, 4)])} + {case(RR, [(35, 6)])} AS saps_ii_score, {case(HR, [(125, 3)])} + {case(RR, [(30, 1)])} AS oasis_score"""
SIMPLE = f"""{case(HR, [(150, 4), (110, 2)])} + {case(RR, [(35, 4), (25, 1)])} + {case(CR, [(3.5, 4), (2, 3), (1.2, 2)])} AS apache_ii_score,
 {case(RR, [(30, 2), (25, 1)])} + {case(HR, [(120, 2)])} + {case(CR, [(5, 4), (3.5, 3), (2, 2), (1.2, 1)])} AS sofa_score,
 {case(HR, [(160, 7), (120, 4)])} AS saps_ii_score, {case(HR, [(125, 3)])} AS oasis_score"""


def output(view, variant, name, method, imputation, outliers, hours, shown, counted, extra):
    used = " + ".join(f"({c} IS NOT NULL)::INT" for c in counted)
    params = ", ".join(f"rnd({c}, 6) AS {c}" for c in shown)
    return f"""SELECT subject_id AS patient_id, hadm_id, stay_id, charttime AS measurement_time, '{name}' AS config_name,
        '{method}' AS aggregation_method, '{imputation}' AS imputation_method, '{outliers}' AS outlier_handling,
        {hours} AS time_window_hours, {params}, {variant}, {used} + {extra} AS total_parameters_used,
        25 - ({used} + {extra}) AS missing_parameters, 0 AS imputed_parameters, rnd(({used} + {extra}) / 25.0, 4) AS data_quality_score
        FROM {view}"""


VIEWS["cv_run1"] = output("cv_pimean", FULL, "mean_based_config", "mean", "mean", "iqr", 24, policies.FULL_OUTPUT, COLS, 7)
VIEWS["cv_run2"] = output("cv_pimedian", FULL, "median_based_config", "median", "median", "percentile", 12, policies.FULL_OUTPUT, COLS, 7)
for src, agg in (("mean", "avg(value)"), ("median", "quantile_cont(value, 0.5)")):
    VIEWS[f"cv_sp{src}"] = (
        "SELECT subject_id, hadm_id, stay_id, charttime, "
        + ", ".join(f"min(CASE WHEN concept_name = '{k}' THEN value END) AS {c}" for k, c in policies.SIMPLE_PARAMETERS.items())
        + f""" FROM (SELECT subject_id, hadm_id, stay_id, concept_name, {agg} AS value, min(charttime) AS charttime FROM cv_pin
               WHERE hadm_id IS NOT NULL AND stay_id IS NOT NULL AND concept_name IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3, 4"""
    )
SC = list(policies.SIMPLE_PARAMETERS.values())
VIEWS["cv_simple1"] = output("cv_spmean", SIMPLE, "mean_based_config", "mean", "mean", "iqr", 24, SC, SC, 8)
VIEWS["cv_simple2"] = output("cv_spmedian", SIMPLE, "median_based_config", "median", "median", "percentile", 12, SC, SC, 8)
for v in ("cv_run1", "cv_run2", "cv_simple1", "cv_simple2"):
    VIEWS[v] = expand_rnd(VIEWS[v])


def shown(df, params):
    return df.drop("calculation_time", "created_at", "updated_at").withColumns(
        {**{c: round_to(c, 6) for c in params}, "data_quality_score": round_to("data_quality_score", 4)}
    )


def run(x, which):
    policy = policies.MEAN_POLICY if which == 1 else policies.MEDIAN_POLICY
    return x.written(f"policy{which}", lambda: policies.run_policy(x.silver, policy))


def simple(x, which):
    policy = policies.MEAN_POLICY if which == 1 else policies.MEDIAN_POLICY
    return x.written(f"simple{which}", lambda: policies.run_policy_simple(x.silver, policy))


@query("t3_policy_windows", "SELECT bronze_id, time_window FROM cv_bins12")
def _(x):
    rows = x.silver.filter("valuenum_std IS NOT NULL").select("bronze_id", "subject_id", "stay_id", "charttime")
    return windows.policy_windows(rows, 12).select("bronze_id", "time_window")


@query("c28_drop_outliers_iqr", "SELECT concept_name, count(*) AS kept, min(value) AS lowest, max(value) AS highest FROM cv_iqr GROUP BY 1")
def _(x):
    rows = policies.drop_outliers_iqr(policies.policy_input(x.silver), 1.5)
    return rows.groupBy("concept_name").agg(F.count(F.lit(1)).alias("kept"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


@query("c29_drop_outliers_band", "SELECT concept_name, count(*) AS kept, min(value) AS lowest, max(value) AS highest FROM cv_band GROUP BY 1")
def _(x):
    rows = policies.drop_outliers_band(policies.policy_input(x.silver), 0.05)
    return rows.groupBy("concept_name").agg(F.count(F.lit(1)).alias("kept"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


@query("a27_aggregate_mean", "SELECT subject_id, hadm_id, stay_id, time_window, concept_name, rnd(value, 6) AS value, charttime FROM cv_pmean")
def _(x):
    rows = policies.drop_outliers_iqr(windows.policy_windows(policies.policy_input(x.silver), 24), 1.5)
    return policies.aggregate_policy(rows, policies.MEAN_POLICY).withColumn("value", round_to("value", 6))


@query("a27_aggregate_median", "SELECT subject_id, hadm_id, stay_id, time_window, concept_name, rnd(value, 6) AS value, charttime FROM cv_pmedian")
def _(x):
    rows = policies.drop_outliers_band(windows.policy_windows(policies.policy_input(x.silver), 12), 0.05)
    return policies.aggregate_policy(rows, policies.MEDIAN_POLICY).withColumn("value", round_to("value", 6))


@query(
    "c26_pivot_measurements",
    "SELECT subject_id, hadm_id, stay_id, charttime, rnd(respiratory_rate, 6) AS respiratory_rate, rnd(heart_rate, 6) AS heart_rate, rnd(paco2, 6) AS paco2, rnd(creatinine, 6) AS creatinine, rnd(ph, 6) AS ph FROM cv_spmean",
)
def _(x):
    rows = policies.aggregate_policy_simple(policies.policy_input(x.silver), policies.MEAN_POLICY)
    wide = policies.pivot_measurements(rows, policies.SIMPLE_PARAMETERS)
    return wide.withColumns({c: round_to(c, 6) for c in SC})


@query("c30_run_mean_policy", "SELECT * FROM cv_run1")
def _(x):
    return shown(policies.run_policy(x.silver, policies.MEAN_POLICY), policies.FULL_OUTPUT)


@query("c30_run_median_policy", "SELECT * FROM cv_run2")
def _(x):
    return shown(policies.run_policy(x.silver, policies.MEDIAN_POLICY), policies.FULL_OUTPUT)


@query("c31_run_simple_mean", "SELECT * FROM cv_simple1")
def _(x):
    return shown(policies.run_policy_simple(x.silver, policies.MEAN_POLICY), SC)


@query("c31_run_simple_median", "SELECT * FROM cv_simple2")
def _(x):
    return shown(policies.run_policy_simple(x.silver, policies.MEDIAN_POLICY), SC)


SHOWN_SCORES = "apache_ii_score, sofa_score, saps_ii_score, oasis_score"


@query(
    "p19_load_scores",
    f"SELECT patient_id, stay_id, measurement_time, {SHOWN_SCORES}, 'config1' AS config FROM cv_run1 WHERE apache_ii_score IS NOT NULL AND sofa_score IS NOT NULL",
)
def _(x):
    return policies.load_scores(run(x, 1), "config1").select("patient_id", "stay_id", "measurement_time", *policies.SCORES, "config")


VIEWS["cv_pairs"] = """
    SELECT a.patient_id, a.hadm_id, a.stay_id, a.measurement_time, """ + ", ".join(
    f"a.{s} AS {s}_config1, b.{s} AS {s}_config2" for s in policies.SCORES
) + """ FROM cv_simple1 a JOIN cv_simple2 b ON a.patient_id IS NOT DISTINCT FROM b.patient_id AND a.hadm_id IS NOT DISTINCT FROM b.hadm_id
      AND a.stay_id IS NOT DISTINCT FROM b.stay_id AND a.measurement_time IS NOT DISTINCT FROM b.measurement_time"""


def pairs(x):
    return policies.pair_scores(simple(x, 1), simple(x, 2))


@query("j7_pair_scores", "SELECT * FROM cv_pairs")
def _(x):
    return pairs(x)


@query(
    "j8_pair_by_patient",
    """SELECT a.patient_id, a.sofa_score AS sofa_score_config1, b.sofa_score AS sofa_score_config2, count(*) AS pairs
       FROM cv_simple1 a JOIN cv_simple2 b ON a.patient_id = b.patient_id GROUP BY 1, 2, 3""",
)
def _(x):
    return policies.pair_scores_by_patient(simple(x, 1), simple(x, 2))


@query(
    "d6_stack_scores",
    " UNION ALL ".join(
        f"SELECT patient_id, config_name, '{s}' AS score_type, {s} AS score_value FROM cv_simple{i}" for i in (1, 2) for s in policies.SCORES
    ),
)
def _(x):
    return policies.stack_scores(simple(x, 1), simple(x, 2))
