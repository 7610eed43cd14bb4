"""Statistics of scores and the comparison of two policies.

Scores take few distinct values. Paired statistics start from the joint count of
value pairs, rank statistics from value counts, so rows are read once and every
later step works on a small table.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayscope.functions import bins as bins_
from stayscope.functions.columns import count_if
from stayscope.functions.policy_scores import SCORES
from stayscope.functions.sofa_rules import severity
from stayscope.functions.tails import normal_p, student_p
from stayscope.operators.ordered import exact_quantiles, running_totals

# Bands of the total score
SEVERITIES = ["Normal", "Mild", "Moderate", "Severe", "Critical"]


def joint_counts(pairs: DataFrame, scores: Sequence[str] = SCORES) -> DataFrame:
    """Rows per score type and pair of values, incomplete pairs left out."""
    per_score = F.array(
        *[F.struct(F.lit(s).alias("score_type"), F.col(f"{s}_config1").cast("double").alias("a"), F.col(f"{s}_config2").cast("double").alias("b")) for s in scores]
    )
    long = pairs.select(F.inline(per_score)).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    return long.groupBy("score_type", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def _rank(hist: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    counts = hist.groupBy(*by, value).agg(F.sum("n").alias("c"))
    placed = running_totals(counts, by, value, ["c"])
    return placed.select(*by, value, (F.col("c_before") + (F.col("c") + 1) / 2.0).alias(f"rank_{value}"), F.col("c").alias(f"ties_{value}"))


def weighted_corr(x: Column, y: Column, w: Column) -> Column:
    """Pearson correlation over counted pairs, NULL where a side is constant."""
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    cov = n * F.sum(w * x * y) - sx * sy
    spread = (n * F.sum(w * x * x) - sx * sx) * (n * F.sum(w * y * y) - sy * sy)
    return F.when(spread > 0, cov / F.sqrt(spread))


def _moments(v: Column, w: Column) -> tuple[Column, Column]:
    n = F.sum(w)
    mean = F.sum(w * v) / n
    variance = (F.sum(w * v * v) - F.sum(w * v) * F.sum(w * v) / n) / (n - 1)
    return mean, F.sqrt(F.greatest(variance, F.lit(0.0)))


def spearman(hist: DataFrame) -> DataFrame:
    ranked = hist.join(_rank(hist, "a", ["score_type"]), ["score_type", "a"]).join(_rank(hist, "b", ["score_type"]), ["score_type", "b"])
    return ranked.groupBy("score_type").agg(weighted_corr(F.col("rank_a"), F.col("rank_b"), F.col("n")).alias("correlation_spearman"))


def wilcoxon(hist: DataFrame) -> DataFrame:
    """Signed-rank statistic and normal-approximation z; zero differences are dropped."""
    diffs = hist.withColumn("d", F.col("a") - F.col("b")).filter("d <> 0").groupBy("score_type", "d").agg(F.sum("n").alias("n"))
    diffs = diffs.withColumn("size", F.abs("d"))
    ranks = _rank(diffs, "size", ["score_type"])
    joined = diffs.join(ranks, ["score_type", "size"])
    t = F.col("ties_size")
    sums = joined.groupBy("score_type").agg(
        F.sum(F.when(F.col("d") > 0, F.col("n") * F.col("rank_size")).otherwise(0.0)).alias("up"),
        F.sum(F.when(F.col("d") < 0, F.col("n") * F.col("rank_size")).otherwise(0.0)).alias("down"),
        F.sum("n").alias("m"),
        # each value of |d| carries its tie count on both its signs, so weigh by n / t
        F.sum(F.col("n") / t * (t.cast("double") * t * t - t)).alias("tie"),
    )
    m = F.col("m").cast("double")
    statistic = F.least("up", "down")
    se = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("tie") / 48)
    return sums.select("score_type", statistic.alias("wilcoxon_statistic"), ((statistic - m * (m + 1) / 4) / se).alias("wilcoxon_z"))


def compare_scores(pairs: DataFrame, min_n: int = 10, p_values: bool = True) -> DataFrame:
    """One row per score type with correlations, differences, tests and moments."""
    hist = joint_counts(pairs)
    a, b, w = F.col("a"), F.col("b"), F.col("n")
    d = a - b
    (mean_a, sd_a), (mean_b, sd_b), (mean_d, sd_d) = _moments(a, w), _moments(b, w), _moments(d, w)
    base = hist.groupBy("score_type").agg(
        F.sum(w).alias("sample_size"),
        weighted_corr(a, b, w).alias("correlation_pearson"),
        (F.sum(w * F.abs(d)) / F.sum(w)).alias("mean_absolute_difference"),
        mean_a.alias("config_1_mean"), sd_a.alias("config_1_std"),
        # distinct score values are few, whatever the number of rows
        F.percentile(a, F.lit(0.5), w).alias("config_1_median"),
        mean_b.alias("config_2_mean"), sd_b.alias("config_2_std"),
        F.percentile(b, F.lit(0.5), w).alias("config_2_median"),
        F.when(sd_d > 0, mean_d / (sd_d / F.sqrt(F.sum(w)))).alias("t_test_statistic"),
    ).filter(F.col("sample_size") > min_n)
    full = base.join(spearman(hist), "score_type", "left").join(wilcoxon(hist), "score_type", "left")
    if not p_values:
        return full
    n = F.col("sample_size").cast("double")

    def corr_p(r: Column) -> Column:
        return student_p(r * F.sqrt((n - 2) / F.greatest(1 - r * r, F.lit(1e-300))), n - 2)

    return full.withColumns(
        {
            "pearson_p_value": corr_p(F.col("correlation_pearson")),
            "spearman_p_value": corr_p(F.col("correlation_spearman")),
            "t_test_p_value": student_p(F.col("t_test_statistic"), n - 1),
            "wilcoxon_p_value": normal_p(F.col("wilcoxon_z")),
        }
    )


def comparison_rows(compared: DataFrame, name: str, config1: str, config2: str, alpha: float = 0.05) -> DataFrame:
    """The comparison table's columns for appending."""
    return compared.select(
        F.lit(name).alias("comparison_name"), F.lit(config1).alias("config_1_name"), F.lit(config2).alias("config_2_name"),
        "score_type", "correlation_pearson", "correlation_spearman", "mean_absolute_difference",
        "config_1_mean", "config_1_median", "config_1_std", "config_2_mean", "config_2_median", "config_2_std",
        "t_test_statistic", "t_test_p_value", "wilcoxon_statistic", "wilcoxon_p_value", "sample_size",
        F.current_timestamp().alias("analysis_date"),
        F.to_json(F.struct(F.lit(alpha).alias("significance_level"), F.lit("paired_analysis").alias("comparison_type"))).alias("analysis_parameters"),
    )


def bonferroni(df: DataFrame, p: str = "p_value", m: int | None = None) -> DataFrame:
    """Adjusted p-value; ``m`` defaults to the number of rows, which are tests."""
    tests = F.lit(m) if m is not None else df.agg(F.count(p)).scalar()
    return df.withColumn("p_adjusted", F.least(F.col(p) * tests, F.lit(1.0)))


def t_test_ind(df: DataFrame, group: str, first: str, second: str, value: str) -> DataFrame:
    """Independent t-test with pooled variance between two groups."""
    v = F.col(value)
    sums = df.filter(v.isNotNull()).agg(
        *[
            f.alias(f"{name}{i}")
            for i, g in ((1, first), (2, second))
            for name, f in (
                ("n", F.count(F.when(F.col(group) == g, v)).cast("double")),
                ("mean", F.avg(F.when(F.col(group) == g, v))),
                ("var", F.var_samp(F.when(F.col(group) == g, v))),
            )
        ]
    )
    df_ = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / df_
    t = (F.col("mean1") - F.col("mean2")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))
    return sums.select(t.alias("t_statistic"), df_.alias("degrees"), "mean1", "mean2").withColumn("p_value", student_p("t_statistic", "degrees"))


def mann_whitney(df: DataFrame, group: str, first: object, value: str, p_value: bool = True) -> DataFrame:
    """Two-sided rank-sum test of group ``first`` against the rest, ties corrected."""
    counts = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("c"), F.count(F.when(F.col(group) == first, 1)).alias("c1")
    )
    placed = running_totals(counts, [], "v", ["c"])
    c = F.col("c").cast("double")
    sums = placed.agg(
        F.sum(F.col("c1") * (F.col("c_before") + (c + 1) / 2)).alias("r1"),
        F.sum("c1").cast("double").alias("n1"), F.sum(c).alias("n"), F.sum(c * c * c - c).alias("tie"),
    ).withColumn("n2", F.col("n") - F.col("n1"))
    u1 = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    product = F.col("n1") * F.col("n2")
    sd = F.sqrt(product / 12 * (F.col("n") + 1 - F.col("tie") / (F.col("n") * (F.col("n") - 1))))
    z = (F.greatest(u1, product - u1) - product / 2 - 0.5) / sd
    out = sums.select(u1.alias("u_statistic"), z.alias("z"), F.col("n1").cast("bigint").alias("n1"), F.col("n2").cast("bigint").alias("n2"))
    return out.withColumn("p_value", F.least(normal_p(F.greatest("z", F.lit(0.0))), F.lit(1.0))) if p_value else out


def bland_altman_points(pairs: DataFrame, score: str = "sofa_score") -> DataFrame:
    a, b = F.col(f"{score}_config1"), F.col(f"{score}_config2")
    return pairs.filter(a.isNotNull() & b.isNotNull()).select(((a + b) / 2.0).alias("pair_mean"), (a - b).cast("double").alias("pair_difference"))


def bland_altman(pairs: DataFrame, score: str = "sofa_score") -> DataFrame:
    """Bias and limits of agreement."""
    bias, sd = F.avg("pair_difference"), F.stddev_samp("pair_difference")
    return bland_altman_points(pairs, score).agg(
        F.count(F.lit(1)).alias("n"), bias.alias("bias"), sd.alias("sd"),
        (bias - 1.96 * sd).alias("lower_limit"), (bias + 1.96 * sd).alias("upper_limit"),
    )


def corr_matrix(df: DataFrame, cols: Sequence[str], by: str | None = None) -> DataFrame:
    """Pairwise-complete correlations as rows, every pair once, from one pass."""

    def complete(x: str, y: str) -> Column:
        a, b = F.col(x).cast("double"), F.col(y).cast("double")
        both = a.isNotNull() & b.isNotNull()
        r = F.corr(F.when(both, a), F.when(both, b))
        return F.when(~F.isnan(r), r)

    cells = F.array(*[F.struct(F.lit(x).alias("first"), F.lit(y).alias("second"), complete(x, y).alias("r")) for x, y in combinations(cols, 2)])
    grouped = df.groupBy(by) if by else df.groupBy()
    out = grouped.agg(cells.alias("cells"))
    return out.select(*([by] if by else []), F.inline("cells"))


def target_correlations(df: DataFrame, cols: Sequence[str], target: str, k: int | None = None) -> DataFrame:
    """Features by strength of correlation with the target; ``k`` keeps the top."""
    t = F.col(target).cast("double")
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.corr(F.col(c).cast("double"), t).alias("r")) for c in cols])
    rows = df.agg(cells.alias("cells")).select(F.inline("cells"))
    rows = rows.withColumn("r", F.when(~F.isnan("r"), F.col("r"))).orderBy(F.desc_nulls_last(F.abs("r")), "feature")
    return rows.limit(k) if k else rows


def histogram(df: DataFrame, value: str, bins: int, density: bool = False) -> DataFrame:
    """Equal-width histogram; empty bins are not listed."""
    rows = df.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    ends = rows.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))).scalar()
    placed = rows.withColumn("_e", ends)
    index = bins_.equal_width_left_closed(F.col("v"), F.col("_e.lo"), F.col("_e.hi"), bins)
    counts = placed.groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("_e").alias("_e"))
    width = (F.col("_e.hi") - F.col("_e.lo")) / bins
    shown = counts.select(
        "bin", (F.col("_e.lo") + F.col("bin") * width).alias("low"), (F.col("_e.lo") + (F.col("bin") + 1) * width).alias("high"), "n",
        *([(F.col("n") / F.col("_e.n") / width).alias("density")] if density else []),
    )
    return shown


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles and the farthest values within 1.5 quartile ranges, per group."""
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    counts = rows.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))
    quartiles = exact_quantiles(rows, by, "v", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    spread = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("v") >= F.col("q1") - spread) & (F.col("v") <= F.col("q3") + spread)
    return counts.join(quartiles, list(by)).groupBy(*by, "q1", "median", "q3").agg(
        F.sum("n").alias("n"), F.min(F.when(inside, F.col("v"))).alias("whisker_low"), F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("outside"),
    )


def mortality_by_bin(df: DataFrame, bin_column: Column, name: str, outcome: str, by: Sequence[str] = ("config_name",), min_n: int = 5) -> DataFrame:
    """Outcome rate per bin and group, small cells left out."""
    rows = df.filter(F.col(outcome).isNotNull()).withColumn(name, bin_column).filter(F.col(name).isNotNull())
    return rows.groupBy(name, *by).agg(F.avg(F.col(outcome).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_n)


def score_bins(df: DataFrame, score: str, bins: int = 10) -> Column:
    """Ten equal right-closed intervals over the score's range in ``df``."""
    ends = df.agg(F.struct(F.min(score).cast("double").alias("lo"), F.max(score).cast("double").alias("hi"))).scalar()
    return bins_.equal_width_right_closed(F.col(score).cast("double"), ends["lo"], ends["hi"], bins)


def pivot_rates(rates: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    return rates.groupBy(row).pivot(column, list(values)).agg(F.first("rate"))


def mortality_report(df: DataFrame, by: str = "config_name") -> DataFrame:
    """Overall (NULL group) and per-policy rate with score moments."""
    return df.rollup(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("hospital_mortality").cast("double")).alias("mortality_rate"),
        F.avg("sofa_score").alias("sofa_mean"), F.stddev_samp("sofa_score").alias("sofa_std"),
        F.avg("apache_ii_score").alias("apache_mean"), F.stddev_samp("apache_ii_score").alias("apache_std"),
    )


def compare_cohorts(df: DataFrame, label: str, score: str = "sofa_score", outcome: str = "hospital_mortality") -> DataFrame:
    """Score distribution with quartiles, severity bands, outcome rate and length of stay per cohort.

    Scores are small integers, so ``percentile`` keeps only a handful of values in memory.
    """
    band = severity(F.col(score))
    quarter = {"score_q25": 0.25, "score_median": 0.5, "score_q75": 0.75}
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("score_mean"), F.stddev_samp(score).alias("score_std"),
        *[F.percentile(score, F.lit(q)).alias(name) for name, q in quarter.items()],
        *[count_if(band == name).alias(f"n_{name.lower()}") for name in SEVERITIES],
        F.avg(F.col(outcome).cast("double")).alias("mortality_rate"), F.avg("los_icu").alias("los_icu_mean"),
    )


def class_balance(df: DataFrame, y: str) -> DataFrame:
    """Class counts, ratio of the larger to the smaller and its severity label."""
    counts = df.agg(F.count(F.when(F.col(y) == 1, 1)).alias("positives"), F.count(F.when(F.col(y) == 0, 1)).alias("negatives"))
    ratio = F.greatest("positives", "negatives") / F.nullif(F.least("positives", "negatives"), F.lit(0))
    return counts.withColumn("imbalance_ratio", ratio).withColumn(
        "severity", F.when(ratio.isNull() | (ratio > 10), "severe").when(ratio > 3, "moderate").otherwise("mild")
    ).withColumn("positive_percent", F.col("positives") * 100.0 / (F.col("positives") + F.col("negatives")))


