"""Contributions of features to a model's predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayscope.operators.models import with_probability
from stayscope.session import written_table


def linear_contributions(df: DataFrame, coefficients: dict[str, float], keys: Sequence[str], background: DataFrame | None = None) -> DataFrame:
    """``coefficient * (value - mean)`` per row and feature; means come from ``background``."""
    cols = list(coefficients)
    base = df if background is None else background
    means = base.agg(F.struct(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])).scalar()
    placed = df.withColumn("_m", means)
    cells = F.array(
        *[F.struct(F.lit(c).alias("feature"), (F.lit(float(b)) * (F.col(c).cast("double") - F.col(f"_m.{c}"))).alias("contribution")) for c, b in coefficients.items()]
    )
    return placed.select(*keys, F.inline(cells))


def _paths(df: DataFrame, model: PipelineModel, cols: Sequence[str], keys: Sequence[str], background: DataFrame, first: int, pairs: int, seed: int) -> DataFrame:
    """(keys, draw, feature, c, base): contributions of paired feature orders, from draw ``first`` on.

    A draw takes one row of the background, from ``background`` (_i, z, _size), and one order of the features. On the way from
    that row to the explained one the features change in this order; the steps of
    the predicted probability are their contributions. The same way in reverse
    order gives a second one, and a draw is the mean of both, so that what the place in the order
    adds on one way it takes off on the other. ``base`` is the prediction of the background row.
    """
    cols, d = list(cols), len(cols)
    rows = df.select(*keys, F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))
    draws = rows.withColumn("draw", F.explode(F.sequence(F.lit(first), F.lit(first + pairs - 1))))
    # a row of the background per draw, in turn and the same for every explained row, so that their bases compare
    size = background.select("_size").limit(1).scalar()
    draws = draws.withColumn("_i", F.pmod(F.col("draw"), size)).join(background.select("_i", "z"), "_i")
    index = F.array(*[F.lit(i) for i in range(d)])
    order = F.transform(F.array_sort(F.transform(index, lambda i: F.struct(F.xxhash64(*keys, F.col("draw"), i, F.lit(seed + 1)).alias("h"), i.alias("i")))), lambda s: s["i"])
    draws = draws.withColumn("_order", order).withColumn("_way", F.explode(F.array(F.col("_order"), F.reverse("_order")))).drop("_order")
    steps = draws.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    # features at places up to the step are those of the row
    changed = F.slice("_way", F.lit(1), F.col("_step"))
    mixed = F.transform(index, lambda i: F.when(F.array_contains(changed, i), F.col("x")[i]).otherwise(F.col("z")[i]))
    inputs = steps.select(*keys, "draw", "_way", "_step", mixed.alias("_v")).select("*", *[F.col("_v")[j].alias(c) for j, c in enumerate(cols) if c not in keys])
    scored = with_probability(model.transform(inputs)).select(*keys, "draw", "_way", "_step", "p")
    # a prediction ends the step of one feature and begins that of the next
    ended = F.when(F.col("_step") > 0, F.struct(F.try_element_at("_way", F.greatest(F.col("_step"), F.lit(1))).alias("i"), F.col("p").alias("v")))
    begun = F.when(F.col("_step") < d, F.struct(F.try_element_at("_way", F.least(F.col("_step") + 1, F.lit(d))).alias("i"), (-F.col("p")).alias("v")))
    parts = scored.select(*keys, "draw", F.when(F.col("_step") == 0, F.col("p")).alias("_base"), F.explode(F.array_compact(F.array(ended, begun))).alias("e"))
    names = F.array(*[F.lit(c) for c in cols])
    per_draw = parts.groupBy(*keys, "draw", names[F.col("e.i")].alias("feature")).agg((F.sum("e.v") / 2).alias("c"))
    base = scored.filter("_step = 0").groupBy(*keys, "draw").agg(F.avg("p").alias("base"))
    return per_draw.join(base, [*keys, "draw"])


def sampled_contributions(
    df: DataFrame, model: PipelineModel, cols: Sequence[str], keys: Sequence[str], background: DataFrame,
    m: int = 8, seed: int = 42, error: float | None = None, max_rounds: int = 16, background_rows: int = 256,
) -> DataFrame:
    """Monte-Carlo Shapley values of the predicted probability, with their standard errors.

    (keys, feature, contribution, standard_error, draws, base): ``m`` paired feature orders are drawn for each row.
    With ``error`` further rounds of ``m`` follow for the rows that have a feature whose standard error is
    larger, up to ``max_rounds``; what is still larger then shows it. The contributions of a row and its ``base``,
    the mean prediction of the background rows it met, add up to its prediction.

    ``background`` gives at most ``background_rows`` rows, picked by hash: a documented sample. The
    work is rows x features x draws, so ``df`` is meant to be a sample, too. Rounds run at once.
    """
    stamp = F.xxhash64(*[F.col(c).cast("double") for c in cols], F.lit(seed))
    z = background.select(F.array(*[F.col(c).cast("double") for c in cols]).alias("z"), stamp.alias("h")).orderBy("h").limit(background_rows)
    listed = z.agg(F.collect_list("z").alias("zs")).select(F.size("zs").alias("_size"), F.posexplode("zs").alias("_i", "z"))
    listed = written_table(listed, "background")
    rows, done = written_table(df, "explained"), None
    open_ = rows
    for k in range(max_rounds if error is not None else 1):
        paths = _paths(open_, model, cols, keys, listed, k * m, m, seed)
        sums = paths.groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"), F.sum("base").alias("b"))
        if done is not None:
            sums = done.unionByName(sums).groupBy(*keys, "feature").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q", "b")])
        done = written_table(sums, "contributions")
        if error is None:
            break
        loose = done.groupBy(*keys).agg(F.max(_standard_error()).alias("e")).filter(F.col("e") > error).select(*keys)
        open_ = written_table(rows.join(loose, list(keys), "left_semi"), "open-rows")
        if open_.isEmpty():
            break
    return done.select(*keys, "feature", (F.col("s") / F.col("n")).alias("contribution"), _standard_error().alias("standard_error"), F.col("n").alias("draws"), (F.col("b") / F.col("n")).alias("base"))


def _standard_error() -> Column:
    """Of a mean of ``n`` draws, from their sum and sum of squares; NULL for a single one."""
    n, s, q = F.col("n"), F.col("s"), F.col("q")
    return F.when(n > 1, F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1) / n))


def importance(contributions: DataFrame, k: int | None = None) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    ranked = contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance")).orderBy(F.desc("importance"), "feature")
    return ranked.limit(k) if k else ranked


def score_importance(contributions: DataFrame) -> DataFrame:
    """Importance of the organ scores alone, with their share among themselves."""
    subset = contributions.filter(F.col("feature").endswith("_score") & (F.col("feature") != "data_completeness_score"))
    means = subset.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("importance"))
    # one row per organ score
    return means.withColumn("share", F.col("importance") / F.sum("importance").over(W.partitionBy()))


def pick_cases(pred: DataFrame, label: str, keys: Sequence[str], score: str = "p", threshold: float = 0.5) -> DataFrame:
    """Most confident true and false positive, lowest-risk true and false negative."""
    called, y = F.col(score) >= threshold, F.col(label) == 1
    case = F.when(called & y, "true_positive").when(called, "false_positive").when(y, "false_negative").otherwise("true_negative")
    rows = pred.withColumn("case_type", case)
    strength = F.when(F.col("case_type").endswith("positive"), -F.col(score)).otherwise(F.col(score))
    picked = rows.groupBy("case_type").agg(F.min(F.struct(strength.alias("o"), *keys, F.col(score).alias("score"))).alias("best"), F.count(F.lit(1)).alias("cases"))
    return picked.select("case_type", *[F.col(f"best.{k}").alias(k) for k in keys], F.col("best.score").alias(score), "cases")


def case_contributions(contributions: DataFrame, cases: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` strongest contributions of each picked case."""
    rows = cases.select("case_type", *keys).join(contributions, list(keys))
    # one row per feature in each case
    order = W.partitionBy("case_type").orderBy(F.desc(F.abs("contribution")), "feature")
    return rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def confidence_by_case(pred: DataFrame, label: str, score: str = "p", by: str = "model", threshold: float = 0.5) -> DataFrame:
    """Mean confidence of each kind of case, one column per kind."""
    called, y = F.col(score) >= threshold, F.col(label) == 1
    case = F.when(called & y, "true_positive").when(called, "false_positive").when(y, "false_negative").otherwise("true_negative")
    sure = F.greatest(F.col(score), 1 - F.col(score))
    kinds = ["true_positive", "false_positive", "false_negative", "true_negative"]
    return pred.withColumn("case_type", case).groupBy(by).pivot("case_type", kinds).agg(F.avg(sure))
