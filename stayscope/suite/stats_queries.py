"""Comparison of the two policies, outcome statistics and plot data."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayscope.functions.bins import cut
from stayscope.functions.columns import round_to
from stayscope.functions.policy_scores import SCORES
from stayscope.operators import outcomes, stats
from stayscope.suite.policy_queries import pairs, simple
from stayscope.suite.registry import query
from stayscope.suite.sql_views import VIEWS, expand_rnd
from stayscope.suite.windowed_queries import cohort

VIEWS["cv_long"] = " UNION ALL ".join(
    f"SELECT '{s}' AS score_type, {s}_config1::DOUBLE AS a, {s}_config2::DOUBLE AS b FROM cv_pairs" for s in SCORES
)


def rounded(df, *cols, digits=6):
    return df.withColumns({c: round_to(c, digits) for c in cols})


@query(
    "s1_s3_s4_s6_compare_scores",
    """SELECT score_type, count(*) AS sample_size, rnd(corr(a, b), 6) AS correlation_pearson,
              rnd(avg(abs(a - b)), 6) AS mean_absolute_difference, rnd(avg(a), 6) AS config_1_mean, rnd(stddev_samp(a), 6) AS config_1_std,
              quantile_cont(a, 0.5) AS config_1_median, rnd(avg(b), 6) AS config_2_mean, rnd(stddev_samp(b), 6) AS config_2_std,
              quantile_cont(b, 0.5) AS config_2_median,
              rnd(avg(a - b) / (nullif(stddev_samp(a - b), 0) / sqrt(count(*))), 5) AS t_test_statistic
       FROM cv_long GROUP BY 1 HAVING count(*) > 10""",
)
def _(x):
    keep = ["correlation_pearson", "mean_absolute_difference", "config_1_mean", "config_1_std", "config_2_mean", "config_2_std"]
    df = stats.compare_scores(pairs(x), p_values=False).drop("correlation_spearman", "wilcoxon_statistic", "wilcoxon_z")
    return rounded(rounded(df, *keep), "t_test_statistic", digits=5)


@query(
    "s2_spearman",
    """WITH r AS (SELECT score_type, rank() OVER (PARTITION BY score_type ORDER BY a) + (count(*) OVER (PARTITION BY score_type, a) - 1) / 2.0 AS ra,
                         rank() OVER (PARTITION BY score_type ORDER BY b) + (count(*) OVER (PARTITION BY score_type, b) - 1) / 2.0 AS rb FROM cv_long)
       SELECT score_type, rnd(corr(ra, rb), 6) AS correlation_spearman FROM r GROUP BY 1""",
)
def _(x):
    return rounded(stats.spearman(stats.joint_counts(pairs(x))), "correlation_spearman")


@query(
    "s5_wilcoxon",
    """WITH d AS (SELECT score_type, a - b AS d FROM cv_long WHERE a <> b),
            r AS (SELECT *, rank() OVER (PARTITION BY score_type ORDER BY abs(d)) + (count(*) OVER (PARTITION BY score_type, abs(d)) - 1) / 2.0 AS rk,
                         count(*) OVER (PARTITION BY score_type, abs(d)) AS t FROM d),
            s AS (SELECT score_type, coalesce(sum(rk) FILTER (WHERE d > 0), 0) AS up, coalesce(sum(rk) FILTER (WHERE d < 0), 0) AS down,
                         count(*)::DOUBLE AS m, sum(t::DOUBLE * t - 1) AS tie FROM r GROUP BY 1)
       SELECT score_type, rnd(least(up, down), 3) AS wilcoxon_statistic,
              rnd((least(up, down) - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - tie / 48), 6) AS wilcoxon_z FROM s""",
)
def _(x):
    df = stats.wilcoxon(stats.joint_counts(pairs(x)))
    return rounded(rounded(df, "wilcoxon_z"), "wilcoxon_statistic", digits=3)


@query(
    "s15_comparison_rows",
    """WITH r AS (SELECT *, rank() OVER (PARTITION BY score_type ORDER BY a) + (count(*) OVER (PARTITION BY score_type, a) - 1) / 2.0 AS ra,
                      rank() OVER (PARTITION BY score_type ORDER BY b) + (count(*) OVER (PARTITION BY score_type, b) - 1) / 2.0 AS rb FROM cv_long),
            k AS (SELECT score_type, a - b AS d, rank() OVER (PARTITION BY score_type ORDER BY abs(a - b))
                      + (count(*) OVER (PARTITION BY score_type, abs(a - b)) - 1) / 2.0 AS rk FROM cv_long WHERE a <> b),
            w AS (SELECT score_type, least(coalesce(sum(rk) FILTER (WHERE d > 0), 0), coalesce(sum(rk) FILTER (WHERE d < 0), 0)) AS stat FROM k GROUP BY 1)
       SELECT 'policy_comparison' AS comparison_name, 'mean_based_config' AS config_1_name, 'median_based_config' AS config_2_name, score_type,
              rnd(corr(a, b), 6) AS correlation_pearson, rnd(corr(ra, rb), 6) AS correlation_spearman, rnd(avg(abs(a - b)), 6) AS mean_absolute_difference,
              rnd(avg(a), 6) AS config_1_mean, quantile_cont(a, 0.5) AS config_1_median, rnd(stddev_samp(a), 6) AS config_1_std,
              rnd(avg(b), 6) AS config_2_mean, quantile_cont(b, 0.5) AS config_2_median, rnd(stddev_samp(b), 6) AS config_2_std,
              rnd(avg(a - b) / (nullif(stddev_samp(a - b), 0) / sqrt(count(*))), 5) AS t_test_statistic, rnd(max(stat), 3) AS wilcoxon_statistic, count(*) AS sample_size
       FROM r LEFT JOIN w USING (score_type) GROUP BY score_type HAVING count(*) > 10""",
)
def _(x):
    compared = stats.comparison_rows(stats.compare_scores(pairs(x)), "policy_comparison", "mean_based_config", "median_based_config")
    # SQL has no tails of distributions; they are tested against published values
    compared = compared.drop("analysis_date", "analysis_parameters", "t_test_p_value", "wilcoxon_p_value")
    six = ["correlation_pearson", "correlation_spearman", "mean_absolute_difference", "config_1_mean", "config_1_std", "config_2_mean", "config_2_std"]
    return rounded(rounded(rounded(compared, *six), "t_test_statistic", digits=5), "wilcoxon_statistic", digits=3)


@query(
    "s16_bonferroni",
    """WITH t AS (SELECT score_type, 1 / (2 + avg(abs(a - b)) * 20) AS p FROM cv_long GROUP BY 1)
       SELECT score_type, rnd(p, 6) AS p_value, rnd(least(p * (SELECT count(*) FROM t), 1), 6) AS p_adjusted FROM t""",
)
def _(x):
    # a formula stands in for the tail of the distribution, which SQL lacks
    compared = stats.compare_scores(pairs(x), p_values=False).select("score_type", (1 / (2 + F.col("mean_absolute_difference") * 20)).alias("p_value"))
    return rounded(stats.bonferroni(compared), "p_value", "p_adjusted")


def both(x):
    return simple(x, 1).unionByName(simple(x, 2))


VIEWS["cv_both"] = "SELECT * FROM cv_simple1 UNION ALL SELECT * FROM cv_simple2"


@query(
    "s7_t_test_ind",
    """SELECT rnd((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) AS t_statistic,
              n1 + n2 - 2 AS degrees, rnd(m1, 6) AS mean1, rnd(m2, 6) AS mean2
       FROM (SELECT count(*)::DOUBLE AS n1, avg(sofa_score) AS m1, var_samp(sofa_score) AS v1 FROM cv_simple1),
            (SELECT count(*)::DOUBLE AS n2, avg(sofa_score) AS m2, var_samp(sofa_score) AS v2 FROM cv_simple2)""",
)
def _(x):
    df = stats.t_test_ind(both(x), "config_name", "mean_based_config", "median_based_config", "sofa_score").drop("p_value")
    return rounded(df, "t_statistic", "mean1", "mean2")


@query(
    "s8_mann_whitney",
    """WITH r AS (SELECT config_name, rank() OVER (ORDER BY sofa_score) + (count(*) OVER (PARTITION BY sofa_score) - 1) / 2.0 AS rk,
                         count(*) OVER (PARTITION BY sofa_score) AS t FROM cv_both),
            s AS (SELECT sum(rk) FILTER (WHERE config_name = 'mean_based_config') AS r1,
                         count(*) FILTER (WHERE config_name = 'mean_based_config')::DOUBLE AS n1, count(*)::DOUBLE AS n, sum(t::DOUBLE * t - 1) AS tie FROM r),
            u AS (SELECT *, n - n1 AS n2, r1 - n1 * (n1 + 1) / 2 AS u1 FROM s)
       SELECT rnd(u1, 3) AS u_statistic,
              rnd((greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - tie / (n * (n - 1)))), 6) AS z,
              n1::BIGINT AS n1, n2::BIGINT AS n2 FROM u""",
)
def _(x):
    df = stats.mann_whitney(both(x), "config_name", "mean_based_config", "sofa_score", p_value=False)
    return rounded(rounded(df, "z"), "u_statistic", digits=3)


@query(
    "s9_bland_altman",
    """SELECT count(*) AS n, rnd(avg(d), 6) AS bias, rnd(stddev_samp(d), 6) AS sd, rnd(avg(d) - 1.96 * stddev_samp(d), 6) AS lower_limit,
              rnd(avg(d) + 1.96 * stddev_samp(d), 6) AS upper_limit
       FROM (SELECT (sofa_score_config1 - sofa_score_config2)::DOUBLE AS d FROM cv_pairs)""",
)
def _(x):
    return rounded(stats.bland_altman(pairs(x)), "bias", "sd", "lower_limit", "upper_limit")


@query(
    "s9_s14_plot_points",
    """SELECT (sofa_score_config1 + sofa_score_config2) / 2.0::DOUBLE AS pair_mean, (sofa_score_config1 - sofa_score_config2)::DOUBLE AS pair_difference
       FROM cv_pairs""",
)
def _(x):
    return stats.bland_altman_points(pairs(x))


NUMERIC = ["total_sofa_score", "respiratory_score", "cardiovascular_score", "creatinine_level", "platelet_count", "urine_output_24h"]


@query(
    "s10_corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS first, '{b}' AS second, rnd(corr({a}, {b}), 5) AS r FROM cv_sofa"
        for i, a in enumerate(NUMERIC)
        for b in NUMERIC[i + 1 :]
    ),
)
def _(x):
    return rounded(stats.corr_matrix(x.sofa, NUMERIC), "r", digits=5)


@query(
    "s11_histogram",
    """SELECT bin, rnd(lo + bin * w, 6) AS low, rnd(lo + (bin + 1) * w, 6) AS high, count(*) AS n, rnd(count(*) / any_value(total) / any_value(w), 8) AS density
       FROM (SELECT CAST(least(floor((v - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, lo, (hi - lo) / 20 AS w, total
             FROM (SELECT total_sofa_score::DOUBLE AS v, min(total_sofa_score) OVER ()::DOUBLE AS lo, max(total_sofa_score) OVER ()::DOUBLE AS hi,
                          count(*) OVER ()::DOUBLE AS total FROM cv_sofa)) GROUP BY bin, lo, w""",
)
def _(x):
    df = rounded(stats.histogram(x.sofa, "total_sofa_score", 20, density=True), "low", "high")
    return rounded(df, "density", digits=8)


@query(
    "s13_box_stats",
    """WITH q AS (SELECT config_name, quantile_cont(sofa_score, 0.25)::DOUBLE AS q1, quantile_cont(sofa_score, 0.5)::DOUBLE AS median,
                         quantile_cont(sofa_score, 0.75)::DOUBLE AS q3 FROM cv_both GROUP BY 1)
       SELECT config_name, q1, median, q3, count(*) AS n,
              min(CASE WHEN sofa_score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN sofa_score END)::DOUBLE AS whisker_low,
              max(CASE WHEN sofa_score BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN sofa_score END)::DOUBLE AS whisker_high,
              count(CASE WHEN sofa_score NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 1 END) AS outside
       FROM cv_both JOIN q USING (config_name) GROUP BY 1, 2, 3, 4""",
)
def _(x):
    return stats.box_stats(both(x), "sofa_score", ["config_name"])


# Outcomes

VIEWS["cv_outcome"] = expand_rnd(
    """SELECT b.patient_id, b.hadm_id, b.config_name, b.apache_ii_score, b.sofa_score, b.saps_ii_score, b.oasis_score,
              a.hospital_expire_flag = 1 AS hospital_mortality, coalesce(a.deathtime BETWEEN s.intime AND s.outtime, FALSE) AS icu_mortality,
              coalesce(a.deathtime <= a.admittime + INTERVAL 30 DAY, FALSE) AS day_30_mortality, a.admission_type,
              CASE s.stay_id % 3 WHEN 0 THEN 'MICU' WHEN 1 THEN 'SICU' ELSE 'CCU' END AS first_careunit,
              10.0::DOUBLE AS los_hospital, 10.0::DOUBLE AS los_icu, p.age, p.gender
       FROM (SELECT patient_id, hadm_id, config_name, max(apache_ii_score) AS apache_ii_score, max(sofa_score) AS sofa_score,
                    max(saps_ii_score) AS saps_ii_score, max(oasis_score) AS oasis_score FROM cv_both GROUP BY 1, 2, 3) b
       JOIN cv_adm a ON a.hadm_id = b.hadm_id JOIN cv_stays s ON s.hadm_id = b.hadm_id LEFT JOIN cv_pat p ON p.subject_id = b.patient_id"""
)


def outcome(x):
    v = x.views
    unit = F.when(F.col("stay_id") % 3 == 0, "MICU").when(F.col("stay_id") % 3 == 1, "SICU").otherwise("CCU")
    stays = v.stays.withColumn("first_careunit", unit)
    return x.written("outcomes", lambda: outcomes.outcome_table(both(x), stays, v.admissions, v.patients))


@query("c32_j5_outcome_table", "SELECT * FROM cv_outcome")
def _(x):
    return outcome(x)


@query(
    "a29_s12_mortality_by_score",
    """SELECT score_bin, config_name, rnd(avg(m), 6) AS rate, count(*) AS n FROM (
         SELECT config_name, hospital_mortality::INT AS m, CAST(greatest(ceil((sofa_score - lo) / (hi - lo) * 10) - 1, 0) AS INTEGER) AS score_bin
         FROM cv_outcome, (SELECT min(sofa_score)::DOUBLE AS lo, max(sofa_score)::DOUBLE AS hi FROM cv_outcome)) GROUP BY 1, 2 HAVING count(*) >= 5""",
)
def _(x):
    df = outcome(x)
    return rounded(stats.mortality_by_bin(df, stats.score_bins(df, "sofa_score"), "score_bin", "hospital_mortality"), "rate")


AGE = "CASE WHEN age > 0 AND age <= 45 THEN '<45' WHEN age <= 65 THEN '45-65' WHEN age <= 80 THEN '65-80' WHEN age <= 100 THEN '80+' END"


@query(
    "a29_mortality_by_age",
    f"""SELECT age_group, max(rate) FILTER (WHERE config_name = 'mean_based_config') AS mean_based_config,
               max(rate) FILTER (WHERE config_name = 'median_based_config') AS median_based_config
        FROM (SELECT {AGE} AS age_group, config_name, rnd(avg(hospital_mortality::INT), 6) AS rate FROM cv_outcome
              WHERE age IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10) GROUP BY 1""",
)
def _(x):
    groups = cut("age", [0, 45, 65, 80, 100], ["<45", "45-65", "65-80", "80+"])
    rates = rounded(stats.mortality_by_bin(outcome(x), groups, "age_group", "hospital_mortality", min_n=10), "rate")
    return stats.pivot_rates(rates, "age_group", "config_name", ["mean_based_config", "median_based_config"])


@query(
    "s17_subgroups",
    """SELECT CASE WHEN age > 0 AND age <= 18 THEN '<=18' WHEN age <= 45 THEN '18-45' WHEN age <= 65 THEN '45-65' WHEN age <= 85 THEN '65-85' WHEN age > 85 THEN '>85' END AS age_group,
              gender, config_name, rnd(avg(hospital_mortality::INT), 6) AS rate, count(*) AS n
       FROM cv_outcome WHERE age IS NOT NULL GROUP BY 1, 2, 3""",
)
def _(x):
    groups = cut("age", [0, 18, 45, 65, 85, None], ["<=18", "18-45", "45-65", "65-85", ">85"])
    return rounded(stats.mortality_by_bin(outcome(x), groups, "age_group", "hospital_mortality", by=["gender", "config_name"], min_n=1), "rate")


@query(
    "a30_mortality_report",
    """SELECT config_name, count(*) AS n, rnd(avg(hospital_mortality::INT), 6) AS mortality_rate, rnd(avg(sofa_score), 6) AS sofa_mean,
              rnd(stddev_samp(sofa_score), 6) AS sofa_std, rnd(avg(apache_ii_score), 6) AS apache_mean, rnd(stddev_samp(apache_ii_score), 6) AS apache_std
       FROM cv_outcome GROUP BY ROLLUP (config_name)""",
)
def _(x):
    return rounded(stats.mortality_report(outcome(x)), "mortality_rate", "sofa_mean", "sofa_std", "apache_mean", "apache_std")


@query(
    "s18_compare_cohorts",
    """SELECT CASE WHEN patient_id IN (SELECT subject_id FROM cv_cohort) THEN 'disease' ELSE 'control' END AS cohort, count(*) AS n,
              rnd(avg(sofa_score), 6) AS score_mean, rnd(stddev_samp(sofa_score), 6) AS score_std, quantile_cont(sofa_score, 0.5)::DOUBLE AS score_median,
              quantile_cont(sofa_score, 0.25)::DOUBLE AS score_q25, quantile_cont(sofa_score, 0.75)::DOUBLE AS score_q75,
              count(*) FILTER (sofa_score = 0) AS n_normal, count(*) FILTER (sofa_score BETWEEN 1 AND 6) AS n_mild, count(*) FILTER (sofa_score BETWEEN 7 AND 12) AS n_moderate,
              count(*) FILTER (sofa_score BETWEEN 13 AND 18) AS n_severe, count(*) FILTER (sofa_score > 18) AS n_critical,
              rnd(avg(hospital_mortality::INT), 6) AS mortality_rate, rnd(avg(los_icu), 6) AS los_icu_mean FROM cv_outcome GROUP BY 1""",
)
def _(x):
    members = cohort(x).select(F.col("subject_id").alias("patient_id")).withColumn("_in", F.lit(True))
    labelled = outcome(x).join(members, "patient_id", "left").withColumn("cohort", F.when(F.col("_in"), "disease").otherwise("control"))
    return rounded(stats.compare_cohorts(labelled, "cohort"), "score_mean", "score_std", "mortality_rate", "los_icu_mean")
