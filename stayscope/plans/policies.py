"""Alternative score tables under an aggregation policy, and their output form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayscope.functions.columns import from_micros, join_null_safe, micros
from stayscope.functions.policy_scores import SCORES, score
from stayscope.operators.ordered import exact_quantiles
from stayscope.operators.windows import policy_windows
from stayscope.session import written_table


@dataclass(frozen=True)
class ScorePolicy:
    name: str
    aggregation: str  # mean or median
    imputation: str  # mean, median or none
    outliers: str  # iqr, percentile or none
    threshold: float
    window_hours: int
    min_observations: int


# The two published policies
MEAN_POLICY = ScorePolicy("mean_based_config", "mean", "mean", "iqr", 1.5, 24, 2)
MEDIAN_POLICY = ScorePolicy("median_based_config", "median", "median", "percentile", 0.05, 12, 3)

# Concept names and the columns they become
PARAMETERS = {
    "Respiratory Rate": "respiratory_rate", "Heart Rate": "heart_rate", "PaCO2": "paco2", "Tidal Volume": "tidal_volume",
    "Minute Ventilation": "minute_ventilation", "Creatinine": "creatinine", "pH": "ph", "Albumin": "albumin",
    "Uric Acid": "uric_acid", "NT-proBNP": "nt_probnp", "D-Dimer": "d_dimer", "Homocysteine": "homocysteine",
    "Procalcitonin": "procalcitonin", "IL-6": "il_6", "IL-8": "il_8", "IL-10": "il_10", "ST2": "st2",
    "Pentraxin-3": "pentraxin_3", "Fraktalkin": "fraktalkin", "sRAGE": "srage", "KL-6": "kl_6", "PAI-1": "pai_1",
    "VEGF": "vegf",
}
SIMPLE_PARAMETERS = {k: PARAMETERS[k] for k in ("Respiratory Rate", "Heart Rate", "PaCO2", "Creatinine", "pH")}
ROW_KEYS = ["subject_id", "hadm_id", "stay_id", "charttime"]
POSSIBLE = 25


def policy_input(silver: DataFrame) -> DataFrame:
    return silver.filter(F.col("valuenum_std").isNotNull()).select(
        "subject_id", "hadm_id", "stay_id", "charttime", "concept_name", F.col("valuenum_std").alias("value"), "sofa_system"
    )


def _within(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Drop rows outside their concept's bounds; concepts are few, so Spark may broadcast them."""
    outside = (F.col("value") < F.col("_lo")) | (F.col("value") > F.col("_hi"))
    kept = df.join(bounds, "concept_name", "left").filter(~F.coalesce(outside, F.lit(False)))
    return kept.drop("_lo", "_hi")


def drop_outliers_iqr(df: DataFrame, k: float = 1.5) -> DataFrame:
    """Keep values inside Tukey's fences of their concept."""
    q = exact_quantiles(df, ["concept_name"], "value", {"q1": 0.25, "q3": 0.75})
    spread = (F.col("q3") - F.col("q1")) * k
    return _within(df, q.select("concept_name", (F.col("q1") - spread).alias("_lo"), (F.col("q3") + spread).alias("_hi")))


def drop_outliers_band(df: DataFrame, p: float = 0.05) -> DataFrame:
    """Keep values between the ``p`` and ``1 - p`` quantiles of their concept."""
    return _within(df, exact_quantiles(df, ["concept_name"], "value", {"_lo": p, "_hi": 1 - p}))


def mean_time(time: str) -> Column:
    """Mean timestamp in whole microseconds, exact for any number of rows.

    Seconds and fractions are summed apart, as one sum of microseconds would
    overflow or, in double, lose its last digits.
    """
    us = micros(time)
    seconds, rest, n = F.sum(F.floor(us / 1_000_000)), F.sum(us % 1_000_000), F.count(time)
    return from_micros(F.floor(seconds / n) * 1_000_000 + F.floor(((seconds % n) * 1_000_000 + rest) / n))


def _combine(df: DataFrame, keys: Sequence[str], method: str, with_time: bool) -> DataFrame:
    """Mean or median of value (and of time) per group, with the group's row count."""
    rows = df
    for k in keys:
        rows = rows.filter(F.col(k).isNotNull())
    first = [] if with_time else [F.min("charttime").alias("charttime")]
    if method == "mean":
        time = [mean_time("charttime").alias("charttime")] if with_time else first
        return rows.groupBy(*keys).agg(F.avg("value").alias("value"), *time, F.count(F.lit(1)).alias("n"))
    if method != "median":
        raise ValueError(f"unknown aggregation {method}")
    if not with_time:
        # a whole stay may be hot: counted values, sorted by ranges
        base = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *first)
        return base.join(exact_quantiles(rows, keys, "value", {"_median": 0.5}), list(keys)).withColumnRenamed("_median", "value")
    # the window in the key bounds a group; the built-in percentile counts values before its one shuffle
    timed = rows.withColumn("_us", micros("charttime") - F.col("stay_start_us"))
    out = timed.groupBy(*keys).agg(
        F.percentile("value", F.lit(0.5)).alias("value"), F.percentile(F.col("_us").cast("double"), F.lit(0.5)).alias("_us"),
        F.count(F.lit(1)).alias("n"), F.min("stay_start_us").alias("_t0"),
    )
    return out.withColumn("charttime", from_micros(F.col("_t0") + F.floor("_us").cast("bigint"))).drop("_us", "_t0")


def aggregate_policy(df: DataFrame, policy: ScorePolicy) -> DataFrame:
    """Value and time per window and concept; groups with too few rows are dropped."""
    keys = ["subject_id", "hadm_id", "stay_id", "time_window", "concept_name"]
    return _combine(df, keys, policy.aggregation, True).filter(F.col("n") >= policy.min_observations).drop("n")


def aggregate_policy_simple(df: DataFrame, policy: ScorePolicy) -> DataFrame:
    """Value per stay and concept over the whole stay, at its first time."""
    return _combine(df, ["subject_id", "hadm_id", "stay_id", "concept_name"], policy.aggregation, False).drop("n")


def pivot_measurements(df: DataFrame, concepts: Mapping[str, str] = PARAMETERS) -> DataFrame:
    """One row per stay and time, one column per listed concept."""
    return df.groupBy(*ROW_KEYS).agg(
        *[F.min(F.when(F.col("concept_name") == name, F.col("value"))).alias(column) for name, column in concepts.items()]
    )


def impute_columns(df: DataFrame, method: str, columns: Sequence[str]) -> DataFrame:
    """Fill each column's gaps by its mean or exact median over all rows."""
    if method == "none":
        return df
    if method == "mean":
        fill = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns])).scalar()
    else:
        long = df.select(*columns).unpivot([], list(columns), "column", "v")
        medians = exact_quantiles(long, ["column"], "v", {"m": 0.5})
        fill = medians.agg(F.struct(*[F.max(F.when(F.col("column") == c, F.col("m"))).alias(c) for c in columns])).scalar()
    # one column holds all fill values, so the subquery is planned once
    filled = df.withColumn("_fill", fill)
    return filled.select(*[F.coalesce(F.col(c), F.col(f"_fill.{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def add_scores(df: DataFrame, variant: str = "full", extra: Mapping[str, Column] | None = None) -> DataFrame:
    """The four published scores; ``extra`` adds a user's own as name and column expression."""
    own = [c.alias(name) for name, c in (extra or {}).items()]
    return df.select("*", *[score(s, variant).cast("int").alias(s) for s in SCORES], *own)


def add_quality(df: DataFrame, counted: Sequence[str]) -> DataFrame:
    """Number of filled columns among ``counted``, of 25 possible."""
    used = sum((F.col(c).isNotNull().cast("int") for c in counted), F.lit(0))
    return (
        df.withColumn("total_parameters_used", used)
        .withColumn("missing_parameters", F.lit(POSSIBLE) - F.col("total_parameters_used"))
        .withColumn("data_quality_score", F.col("total_parameters_used") / float(POSSIBLE))
    )


FULL_OUTPUT = ["respiratory_rate", "heart_rate", "paco2", "tidal_volume", "minute_ventilation", "creatinine", "ph", "albumin"]
SIMPLE_OUTPUT = ["respiratory_rate", "heart_rate", "paco2", "creatinine", "ph"]


def prepare_scores(df: DataFrame, policy: ScorePolicy, parameters: Sequence[str] = FULL_OUTPUT) -> DataFrame:
    """Output columns in fixed order with the policy's settings; absent ones are NULL."""

    def column(c: str) -> Column:
        return F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c)

    now = F.current_timestamp()
    return df.select(
        F.col("subject_id").alias("patient_id"), "hadm_id", "stay_id", F.col("charttime").alias("measurement_time"),
        now.alias("calculation_time"), F.lit(policy.name).alias("config_name"),
        F.lit(policy.aggregation).alias("aggregation_method"), F.lit(policy.imputation).alias("imputation_method"),
        F.lit(policy.outliers).alias("outlier_handling"), F.lit(policy.window_hours).alias("time_window_hours"),
        *[column(c) for c in parameters], *SCORES,
        "total_parameters_used", "missing_parameters", F.lit(0).alias("imputed_parameters"), "data_quality_score",
        now.alias("created_at"), now.alias("updated_at"),
    )


def run_policy(silver: DataFrame, policy: ScorePolicy, concepts: Mapping[str, str] = PARAMETERS, count_ids: bool = True) -> DataFrame:
    """Windows, outlier removal, aggregation, pivot, imputation and scores of one policy.

    Windows are cut before outliers go, so removed rows still shape the bins. The
    kept rows and the pivoted rows feed several branches each (quantiles, fill
    values) and are therefore written to the shared folder in between.
    """
    rows = policy_windows(policy_input(silver), policy.window_hours)
    if policy.outliers == "iqr":
        rows = drop_outliers_iqr(rows, policy.threshold)
    elif policy.outliers == "percentile":
        rows = drop_outliers_band(rows, policy.threshold)
    if policy.aggregation == "median":
        rows = written_table(rows, "policy-rows")
    wide = written_table(pivot_measurements(aggregate_policy(rows, policy), concepts), "policy-wide")
    columns = list(concepts.values())
    scored = add_scores(impute_columns(wide, policy.imputation, columns))
    counted = [*columns, *((*ROW_KEYS[:3], *SCORES) if count_ids else ())]
    return prepare_scores(add_quality(scored, counted), policy)


def run_policy_simple(silver: DataFrame, policy: ScorePolicy, concepts: Mapping[str, str] = SIMPLE_PARAMETERS, count_ids: bool = True) -> DataFrame:
    """Whole-stay aggregation without windows, outlier handling or imputation."""
    wide = pivot_measurements(aggregate_policy_simple(policy_input(silver), policy), concepts)
    scored = add_scores(wide, "simple").withColumn("_window", F.lit(policy.window_hours))
    counted = [*concepts.values(), *((*ROW_KEYS[:3], *SCORES, "_window") if count_ids else ())]
    return prepare_scores(add_quality(scored, counted), policy, SIMPLE_OUTPUT)


def load_scores(table: DataFrame, tag: str) -> DataFrame:
    """Rows with both main scores, tagged with their policy."""
    both = F.col("apache_ii_score").isNotNull() & F.col("sofa_score").isNotNull()
    return table.filter(both).withColumn("config", F.lit(tag))


def pair_scores(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("patient_id", "hadm_id", "stay_id", "measurement_time")) -> DataFrame:
    """Inner join on all keys, where NULL keys match each other."""

    def side(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(*keys, *[F.col(s).alias(f"{s}_{suffix}") for s in SCORES])

    return join_null_safe(side(a, "config1"), side(b, "config2"), keys)


def best_per_patient(df: DataFrame, score_column: str) -> DataFrame:
    return df.select("patient_id", F.col(score_column)).dropna()


def pair_scores_by_patient(a: DataFrame, b: DataFrame, score_column: str = "sofa_score") -> DataFrame:
    """How often each pair of score values meets when rows are paired by patient alone.

    Every row of one side meets every row of the other for the same patient. Both
    sides are counted per patient and value first, so what is joined is the small
    number of distinct values and the pairs appear as a weight, not as rows.
    """

    def side(df: DataFrame, suffix: str) -> DataFrame:
        return best_per_patient(df, score_column).groupBy("patient_id", F.col(score_column).alias(f"{score_column}_{suffix}")).agg(
            F.count(F.lit(1)).alias(f"n_{suffix}")
        )

    joined = side(a, "config1").join(side(b, "config2"), "patient_id")
    return joined.select(
        "patient_id", f"{score_column}_config1", f"{score_column}_config2", (F.col("n_config1") * F.col("n_config2")).alias("pairs")
    )


def stack_scores(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both policies' scores in long form: score type, value, policy."""

    def long(df: DataFrame) -> DataFrame:
        return df.select("patient_id", "config_name", *SCORES).unpivot(["patient_id", "config_name"], SCORES, "score_type", "score_value")

    return long(a).unionByName(long(b)).filter(F.col("score_value").isNotNull())
