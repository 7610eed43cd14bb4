"""Model preparation, evaluation and explanations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stayscope.functions.columns import round_to
from stayscope.operators import explain, features, models, preparation
from stayscope.session import shared_folder
from stayscope.suite.feature_queries import PHASE, labelled, split
from stayscope.suite.registry import query
from stayscope.suite.sql_views import VIEWS
from stayscope.suite.stats_queries import rounded

Y = "target_mortality_48h"
KEYS = ["stay_id", "charttime"]
BASIC = ["total_sofa_score", "hours_from_admission", "data_completeness_score"]
GAPPY = ["platelet_count", "creatinine_level", "gcs_total"]
# A fixed formula stands in for a model where SQL has to give the same predictions
RISK = "(total_sofa_score * 4 + cardiovascular_score * 3 + CAST(floor(hours_from_admission / 24) AS INTEGER)) / 100.0::DOUBLE"
VIEWS["cv_pred"] = f"SELECT stay_id, charttime, split, {Y} AS y, {RISK} AS p FROM cv_split"


def predictions(x):
    p = (F.col("total_sofa_score") * 4 + F.col("cardiovascular_score") * 3 + F.floor(F.col("hours_from_admission") / 24)) / 100.0
    return split(x).select(*KEYS, "split", F.col(Y).alias("y"), p.alias("p"))


@query(
    "m8_impute_median",
    "SELECT stay_id, charttime, "
    + ", ".join(f"rnd(coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM cv_split WHERE split = 'train')), 6) AS {c}" for c in GAPPY)
    + " FROM cv_split",
)
def _(x):
    raw = features.temporal_split(labelled(x))
    done = models.impute_median(raw.filter("split = 'train'"), raw, GAPPY)
    return rounded(done.select(*KEYS, *GAPPY), *GAPPY)


@query(
    "m7_scale",
    "SELECT stay_id, charttime, "
    + ", ".join(
        f"rnd(({c} - (SELECT avg({c}) FROM cv_split WHERE split = 'train')) / (SELECT stddev_pop({c}) FROM cv_split WHERE split = 'train'), 5) AS {c}" for c in BASIC
    )
    + " FROM cv_split",
)
def _(x):
    df = split(x)
    return rounded(models.scale_columns(df.filter("split = 'train'"), df, BASIC).select(*KEYS, *BASIC), *BASIC, digits=5)


VIEWS["cv_at"] = """
    SELECT split, p, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY split) AS pt, sum(neg) OVER (PARTITION BY split) AS nt
    FROM (SELECT split, p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM cv_pred GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY split ORDER BY p DESC)"""


@query(
    "m12_evaluate",
    """SELECT a.split, rnd(a.auc, 6) AS roc_auc, rnd(a.ap, 6) AS average_precision, rnd(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
              rnd(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, rnd(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
              rnd((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, CAST(tp + tn + fp + fn AS BIGINT) AS rows
       FROM (SELECT split, sum(pos * (nt - fp + neg / 2)) / nullif(max(pt) * max(nt), 0) AS auc, sum(pos * tp / (tp + fp)) / nullif(max(pt), 0) AS ap FROM cv_at GROUP BY 1) a
       JOIN (SELECT split, sum((p >= 0.5 AND y = 1)::INT)::DOUBLE AS tp, sum((p >= 0.5 AND y = 0)::INT)::DOUBLE AS fp,
                    sum((p < 0.5 AND y = 1)::INT)::DOUBLE AS fn, sum((p < 0.5 AND y = 0)::INT)::DOUBLE AS tn FROM cv_pred GROUP BY 1) c USING (split)""",
)
def _(x):
    df = models.evaluate(predictions(x), "y", by=["split"])
    return rounded(df, "roc_auc", "average_precision", "f1", "precision", "recall", "accuracy")


@query(
    "m13_curve_points",
    "SELECT split, rnd(p, 6) AS threshold, rnd(tp / nullif(pt, 0), 6) AS tpr, rnd(fp / nullif(nt, 0), 6) AS fpr, rnd(tp / (tp + fp), 6) AS precision FROM cv_at",
)
def _(x):
    return rounded(models.curve_points(predictions(x), "y", by=["split"]), "threshold", "tpr", "fpr", "precision")


# Coefficients of the linear explanation check
COEFFICIENTS = {"total_sofa_score": 0.4, "hours_from_admission": -0.01, "data_completeness_score": 1.5}
VIEWS["cv_contrib"] = " UNION ALL ".join(
    f"SELECT stay_id, charttime, '{c}' AS feature, {b} * ({c} - avg({c}) OVER ()) AS contribution FROM cv_lab48" for c, b in COEFFICIENTS.items()
)


def contributions(x):
    return explain.linear_contributions(labelled(x), COEFFICIENTS, KEYS)


@query("m15_linear_contributions", "SELECT stay_id, charttime, feature, rnd(contribution, 5) AS contribution FROM cv_contrib")
def _(x):
    return rounded(contributions(x), "contribution", digits=5)


@query("m17_importance", "SELECT feature, rnd(avg(abs(contribution)), 5) AS importance FROM cv_contrib GROUP BY 1")
def _(x):
    return rounded(explain.importance(contributions(x)), "importance", digits=5)


SCORE_COEFFICIENTS = {"cardiovascular_score": 0.5, "renal_score": -0.25, "hepatic_score": 0.75, "data_completeness_score": 1.5}


@query(
    "m17_score_importance",
    "WITH i AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg(abs({b} * ({c} - m))) AS importance FROM cv_lab48, (SELECT avg({c}) AS m FROM cv_lab48)"
        for c, b in SCORE_COEFFICIENTS.items()
        if c != "data_completeness_score"
    )
    + ") SELECT feature, rnd(importance, 5) AS importance, rnd(importance / sum(importance) OVER (), 5) AS share FROM i",
)
def _(x):
    given = explain.linear_contributions(labelled(x), SCORE_COEFFICIENTS, KEYS)
    return rounded(explain.score_importance(given), "importance", "share", digits=5)


CASE = "CASE WHEN p >= 0.5 AND y = 1 THEN 'true_positive' WHEN p >= 0.5 THEN 'false_positive' WHEN y = 1 THEN 'false_negative' ELSE 'true_negative' END"


@query(
    "m18_pick_cases",
    f"""SELECT case_type, stay_id, charttime, rnd(p, 6) AS p, cases FROM (
          SELECT *, count(*) OVER (PARTITION BY case_type) AS cases,
                 row_number() OVER (PARTITION BY case_type ORDER BY CASE WHEN case_type LIKE '%positive' THEN -p ELSE p END, stay_id, charttime) AS r
          FROM (SELECT *, {CASE} AS case_type FROM cv_pred)) WHERE r = 1""",
)
def _(x):
    return rounded(explain.pick_cases(predictions(x), "y", KEYS), "p")


@query(
    "m19_case_contributions",
    f"""WITH c AS (SELECT case_type, stay_id, charttime FROM (
          SELECT *, row_number() OVER (PARTITION BY case_type ORDER BY CASE WHEN case_type LIKE '%positive' THEN -p ELSE p END, stay_id, charttime) AS r
          FROM (SELECT *, {CASE} AS case_type FROM cv_pred)) WHERE r = 1)
        SELECT stay_id, charttime, case_type, feature, rnd(contribution, 5) AS contribution,
               CAST(row_number() OVER (PARTITION BY case_type ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS position
        FROM c JOIN cv_contrib USING (stay_id, charttime)""",
)
def _(x):
    cases = explain.pick_cases(predictions(x), "y", KEYS)
    return rounded(explain.case_contributions(contributions(x), cases, KEYS), "contribution", digits=5)


@query(
    "m19_confidence_by_case",
    "SELECT split AS model, "
    + ", ".join(f"rnd(avg(CASE WHEN k = '{k}' THEN greatest(p, 1 - p) END), 6) AS {k}" for k in ("true_positive", "false_positive", "false_negative", "true_negative"))
    + f" FROM (SELECT *, {CASE} AS k FROM cv_pred) GROUP BY 1",
)
def _(x):
    df = explain.confidence_by_case(predictions(x).withColumnRenamed("split", "model"), "y")
    return rounded(df, "true_positive", "false_positive", "false_negative", "true_negative")


# Fitted models: no SQL gives the same numbers

FITTED = ["total_sofa_score", "cardiovascular_score", "renal_score", "mean_arterial_pressure", "creatinine_level", "hours_from_admission", "hypotensive", "oliguria"]


def ready(x):
    df = split(x)
    return models.scale_columns(df.filter("split = 'train'"), df, FITTED).withColumn(Y, F.col(Y).cast("int"))


VIEWS["cv_classes"] = f"SELECT {Y}, count(*) AS n FROM cv_split WHERE split = 'train' GROUP BY 1"


@query(
    "m9_smote",
    f"""WITH scale AS (SELECT avg(total_sofa_score) AS m, stddev_pop(total_sofa_score) AS s FROM cv_split WHERE split = 'train')
        SELECT {Y}, FALSE AS synthetic, count(*) AS rows, rnd(avg((total_sofa_score - m) / s), 4) AS mean_given FROM cv_split, scale WHERE split = 'train' GROUP BY 1
        UNION ALL
        SELECT {Y}, TRUE, (SELECT max(n) FROM cv_classes) - n, NULL FROM cv_classes
        WHERE n >= 2 AND n < (SELECT max(n) FROM cv_classes)""",
)
def _(x):
    given = F.when(~F.col("synthetic"), F.col("total_sofa_score"))
    return balanced(x).groupBy(Y, "synthetic").agg(F.count(F.lit(1)).alias("rows"), round_to(F.avg(given), 4).alias("mean_given"))


def balanced(x):
    train = ready(x).filter("split = 'train'").select("subject_id", *KEYS, *FITTED, Y)
    return models.smote(train, FITTED, Y, ["stay_id", "charttime"])


def fitted(x, kind):
    key = f"model-{kind}"
    if key not in x.models:
        train = x.written("balanced", lambda: balanced(x))
        x.models[key] = models.fit_lr(train, FITTED, Y) if kind == "lr" else models.fit_rf(train, FITTED, Y)
    return x.models[key]


def scored(x):
    parts = [models.with_probability(fitted(x, k).transform(ready(x))).select(*KEYS, "split", Y, "p", F.lit(k).alias("model")) for k in ("lr", "rf")]
    return parts[0].unionByName(parts[1])


@query("m10_m11_m12_fitted_models")
def _(x):
    return models.evaluate(scored(x), Y, by=["model", "split"])


@query("m14_overfit_gap")
def _(x):
    return models.overfit_gap(models.evaluate(scored(x), Y, by=["model", "split"]))


@query("m14_best_model")
def _(x):
    return models.best_model(models.evaluate(scored(x), Y, by=["model", "split"]))


# The same two operators over the formula's predictions and their complement, where SQL has the numbers
VIEWS["cv_two"] = f"""
    SELECT 'formula' AS model, split, y, p FROM cv_pred UNION ALL SELECT 'reverse', split, y, 1 - p FROM cv_pred"""
VIEWS["cv_two_metrics"] = """
    SELECT model, split, (sum(rk) FILTER (WHERE y = 1) - max(np) * (max(np) + 1) / 2) / nullif(max(np) * max(nn), 0) AS auc,
           coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1
    FROM (SELECT *, rank() OVER (PARTITION BY model, split ORDER BY p) + (count(*) OVER (PARTITION BY model, split, p) - 1) / 2.0 AS rk,
                 (sum(y) OVER g)::DOUBLE AS np, (sum(1 - y) OVER g)::DOUBLE AS nn, (sum((p >= 0.5 AND y = 1)::INT) OVER g)::DOUBLE AS tp,
                 (sum((p >= 0.5 AND y = 0)::INT) OVER g)::DOUBLE AS fp, (sum((p < 0.5 AND y = 1)::INT) OVER g)::DOUBLE AS fn
          FROM cv_two WINDOW g AS (PARTITION BY model, split))
    GROUP BY 1, 2, tp, fp, fn"""


def two_metrics(x):
    p = predictions(x).withColumn("model", F.lit("formula"))
    return models.evaluate(p.unionByName(p.withColumns({"model": F.lit("reverse"), "p": 1 - F.col("p")})), "y", by=["model", "split"])


@query(
    "m14_formula_gap",
    """SELECT model, rnd(max(auc) FILTER (WHERE split = 'train') - max(auc) FILTER (WHERE split = 'val'), 6) AS auc_gap,
              rnd(max(f1) FILTER (WHERE split = 'train') - max(f1) FILTER (WHERE split = 'val'), 6) AS f1_gap FROM cv_two_metrics GROUP BY 1""",
)
def _(x):
    return rounded(models.overfit_gap(two_metrics(x)), "auc_gap", "f1_gap")


@query("m14_formula_best", "SELECT model, rnd(auc, 6) AS roc_auc FROM cv_two_metrics WHERE split = 'test' ORDER BY coalesce(auc, -1) DESC, model LIMIT 1")
def _(x):
    return rounded(models.best_model(two_metrics(x)), "roc_auc")


def explained(x):
    """50 test rows, as the feature has it, with contributions of the forest's inputs."""
    df = ready(x)
    sample = models.sample_rows(df.filter("split = 'test'"), 50, KEYS)
    return x.written("explained", lambda: explain.sampled_contributions(sample, fitted(x, "rf"), FITTED, KEYS, df.filter("split = 'train'")))


@query("m16_sampled_contributions")
def _(x):
    return explained(x)


@query(
    "m16_forest_adds_up",
    """SELECT stay_id, charttime, TRUE AS adds_up, 8 AS features, 8 AS draws, TRUE AS has_error FROM
       (SELECT * FROM cv_split WHERE split = 'test' ORDER BY md5(concat_ws('|', stay_id, charttime, 42)), stay_id, charttime LIMIT 50)""",
)
def _(x):
    # the contributions of a row and the predictions of the background it met give its own prediction
    total = explained(x).groupBy(*KEYS).agg(
        (F.sum("contribution") + F.max("base")).alias("total"), F.count(F.lit(1)).alias("features"), F.max("draws").alias("draws"),
        F.min(F.col("standard_error").isNotNull() & (F.col("standard_error") >= 0)).alias("has_error"),
    )
    sample = models.sample_rows(ready(x).filter("split = 'test'"), 50, KEYS)
    p = models.with_probability(fitted(x, "rf").transform(sample)).select(*KEYS, "p")
    return p.join(total, KEYS).select(*KEYS, (F.abs(F.col("total") - F.col("p")) < 1e-9).alias("adds_up"), "features", "draws", "has_error")


@query(
    "m10_newton_score_equations",
    "SELECT unnest([" + ", ".join(f"'{c}'" for c in ["intercept", *FITTED]) + "]) AS feature, 0.0::DOUBLE AS gradient",
)
def _(x):
    # at the solution every score equation holds; the sums are made anew from the rows
    train = newton_rows(x)
    return rounded(models.score_equations(train, models.fit_newton(train, FITTED, Y), Y), "gradient")


def newton_rows(x):
    return x.written("newton", lambda: ready(x).filter("split = 'train'").select(*KEYS, *FITTED, Y))


@query(
    "m10_newton_one_feature",
    f"""SELECT * FROM (WITH RECURSIVE scale AS (SELECT avg(total_sofa_score) AS m, stddev_pop(total_sofa_score) AS s FROM cv_split WHERE split = 'train'),
        points AS (SELECT (total_sofa_score - m) / s AS x, {Y}::DOUBLE AS y FROM cv_split, scale WHERE split = 'train'),
        fit AS (
          SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
          UNION ALL
          SELECT i + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
          FROM (SELECT i, a, b, sum(p - y) AS ga, sum((p - y) * x) + b AS gb, sum(p * (1 - p)) AS haa, sum(p * (1 - p) * x) AS hab, sum(p * (1 - p) * x * x) + 1 AS hbb
                FROM (SELECT i, a, b, x, y, 1 / (1 + exp(-(a + b * x))) AS p FROM fit, points WHERE i < 25) GROUP BY i, a, b))
        SELECT rnd(b, 6) AS coefficient, rnd(a, 6) AS intercept FROM fit WHERE i = 25)""",
)
def _(x):
    fit = models.fit_newton(newton_rows(x), ["total_sofa_score"], Y)
    return rounded(x.spark.range(1).select(F.lit(fit.coefficients["total_sofa_score"]).alias("coefficient"), F.lit(fit.intercept).alias("intercept")), "coefficient", "intercept")


def fitted_contributions(x):
    """Of every row, under the fitted regression, against the training rows."""
    df = ready(x)
    return explain.linear_contributions(df, models.linear_terms(fitted(x, "lr"), FITTED)[0], KEYS, df.filter("split = 'train'"))


@query("m15_fitted_contributions")
def _(x):
    return fitted_contributions(x)


@query("m15_fitted_adds_up", "SELECT stay_id, charttime, TRUE AS adds_up FROM cv_split")
def _(x):
    # contributions and the model's value at the training means give the log odds of its own prediction
    df, model = ready(x), fitted(x, "lr")
    slope, intercept = models.linear_terms(model, FITTED)
    p = models.with_probability(model.transform(df)).select(*KEYS, "p")
    total = fitted_contributions(x).groupBy(*KEYS).agg(F.sum("contribution").alias("total"))
    middle = sum((F.avg(F.col(c).cast("double")) * b for c, b in slope.items()), F.lit(intercept))
    at_means = df.filter("split = 'train'").agg(middle.alias("m")).scalar()
    odds = F.col("total") + at_means
    return p.join(total, KEYS).select(*KEYS, (F.abs(1 / (1 + F.exp(-odds)) - F.col("p")) < 1e-9).alias("adds_up"))


@query("m17_fitted_importance")
def _(x):
    return explain.importance(fitted_contributions(x))


@query("m19_fitted_cases")
def _(x):
    pred = scored(x).filter("model = 'lr'")
    return explain.case_contributions(fitted_contributions(x), explain.pick_cases(pred, Y, KEYS), KEYS)


STORED = ["total_sofa_score", "hours_from_admission", "creatinine_level", "platelet_count", "gcs_total"]
_FILLED = ", ".join(f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM cv_split WHERE split = 'train'))::DOUBLE AS {c}" for c in STORED)
VIEWS["cv_filled"] = f"SELECT stay_id, charttime, split, {PHASE} AS p, {_FILLED} FROM (SELECT *, hours_from_admission AS h FROM cv_split)"


@query(
    "io12_saved_pipeline",
    "SELECT stay_id, charttime, CASE WHEN p IS NOT NULL THEN (SELECT count(DISTINCT g.p) FROM cv_filled g WHERE split = 'train' AND g.p < f.p)::DOUBLE END AS admission_phase_encoded, "
    + ", ".join(f"rnd(({c} - (SELECT avg({c}) FROM cv_filled WHERE split = 'train')) / (SELECT stddev_pop({c}) FROM cv_filled WHERE split = 'train'), 5) AS {c}" for c in STORED)
    + f", TRUE AS same, 'lr,newton' AS names, (SELECT count(*) FROM cv_split WHERE split = 'train') AS train_rows, '{Y}' AS target FROM cv_filled f",
)
def _(x):
    # fitted on raw training rows, saved, loaded, and asked again
    raw = features.temporal_split(features.temporal_features(labelled(x))).withColumn(Y, F.col(Y).cast("int"))
    train = raw.filter("split = 'train'")
    ready_made = preparation.fit_preparation(train, STORED, ["admission_phase"])
    prepared = x.written("prepared", lambda: ready_made.transform(train))
    inputs = STORED
    fitted_models = {"lr": models.fit_lr(prepared, inputs, Y), "newton": models.fit_newton(prepared, inputs, Y).pipeline()}
    made = preparation.Artefact(ready_made, fitted_models, {"features": inputs, "target": Y, "train_rows": train.count(), "balancing": "none", "split": "temporal"})
    path = f"{shared_folder(x.spark)}/{x.spark.sparkContext.applicationId}/artefact-{uuid.uuid4().hex}"
    preparation.save_artefact(made, path)
    found = preparation.load_artefact(x.spark, path)
    again = {n: models.with_probability(found.predict(raw, n)).select(*KEYS, *inputs, "admission_phase_encoded", F.col("p").alias(f"p_{n}")) for n in found.models}
    before = {n: models.with_probability(made.predict(raw, n)).select(*KEYS, F.col("p").alias(f"q_{n}")) for n in made.models}
    out = again["lr"].join(again["newton"].select(*KEYS, "p_newton"), KEYS).join(before["lr"], KEYS).join(before["newton"], KEYS)
    out = out.withColumn("same", (F.col("p_lr") == F.col("q_lr")) & (F.col("p_newton") == F.col("q_newton")) & F.col("p_lr").between(0, 1))
    out = out.withColumns({"names": F.lit(",".join(sorted(found.models))), "train_rows": F.lit(found.metadata["train_rows"]).cast("bigint"), "target": F.lit(found.metadata["target"])})
    return rounded(out.select(*KEYS, *inputs, "admission_phase_encoded", "same", "names", "train_rows", "target"), *STORED, digits=5)
