"""Risk models with Spark ML: preparation, fitting, evaluation."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayscope.operators import forest
from stayscope.operators.neighbours import nearest
from stayscope.operators.ordered import exact_quantiles, global_positions, running_totals
from stayscope.session import written_table


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows picked by a seeded hash of their keys, the same for any partitioning."""
    return df.orderBy(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary")), *keys).limit(n)


def column_medians(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact median per column, as one row of columns."""
    doubles = train.select(*[F.col(c).cast("double").alias(c) for c in cols])
    long = doubles.unpivot([], list(cols), "column", "v")
    medians = exact_quantiles(long, ["column"], "v", {"m": 0.5})
    return medians.agg(*[F.max(F.when(F.col("column") == c, F.col("m"))).alias(c) for c in cols])


def impute_median(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Gaps of ``df`` filled with the training medians."""
    fill = column_medians(train, cols).select(F.struct(*cols)).scalar()
    filled = df.withColumn("_fill", fill)
    return filled.select(
        *[F.coalesce(F.col(c).cast("double"), F.col(f"_fill.{c}")).alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def scale_columns(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns centred and divided by the population standard deviation of ``train``."""
    stats = train.agg(
        F.struct(*[F.struct(F.avg(F.col(c).cast("double")).alias("m"), F.stddev_pop(F.col(c).cast("double")).alias("s")).alias(c) for c in cols])
    ).scalar()
    placed = df.withColumn("_s", stats)

    def scaled(c: str):
        spread = F.col(f"_s.{c}.s")
        return ((F.col(c).cast("double") - F.col(f"_s.{c}.m")) / F.when(spread > 0, spread).otherwise(1.0)).alias(c)

    return placed.select(*[scaled(c) if c in cols else F.col(c) for c in df.columns])


def smote(df: DataFrame, cols: Sequence[str], label: str, keys: Sequence[str], k: int = 3, seed: int = 42) -> DataFrame:
    """Oversample the minority class to balance by moving towards nearest neighbours.

    Every minority row serves equally often, the first rows by position once
    more, so that the classes end up exactly equal. Neighbour and step are picked
    by a seeded hash of row and copy.
    """
    counts = {int(r[label]): r["count"] for r in df.groupBy(label).count().collect()}  # one row per class
    doubles = df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])
    doubles = doubles.withColumn("synthetic", F.lit(False))
    if len(counts) < 2:
        return doubles
    minority = min(counts, key=lambda c: (counts[c], -c))
    have, need = counts[minority], max(counts.values()) - counts[minority]
    if need == 0 or have < 2:
        return doubles
    chosen = df.filter(F.col(label) == minority)
    numbered = global_positions(chosen, keys, "id")
    points = written_table(
        numbered.select("id", F.array(*[F.col(c).cast("double") for c in cols]).alias("x"), F.struct(*df.columns).alias("row")), "minority"
    )
    near = nearest(points, k).select("id", "other", "position")
    each, extra = divmod(need, have)
    copies = points.withColumn("_n", F.when(F.col("id") <= extra, each + 1).otherwise(each)).filter("_n > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    pick = F.pmod(F.xxhash64("id", "copy", F.lit(seed)), F.lit(min(k, have - 1))) + 1
    u = F.pmod(F.xxhash64("id", "copy", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)
    drawn = copies.withColumn("position", pick.cast("int")).withColumn("u", u).join(near, ["id", "position"])
    drawn = drawn.join(points.select(F.col("id").alias("other"), F.col("x").alias("y")), "other")
    moved = F.zip_with("x", "y", lambda a, b: a + (b - a) * F.col("u"))
    new = drawn.withColumn("_z", moved).select(
        *[F.col("_z")[list(cols).index(c)].alias(c) if c in cols else F.col(f"row.{c}").alias(c) for c in df.columns],
        F.lit(True).alias("synthetic"),
    )
    return doubles.unionByName(new)


def fit_lr(train: DataFrame, cols: Sequence[str], label: str, c: float = 1.0, max_iter: int = 1000) -> PipelineModel:
    """L2-penalised logistic regression; ``c`` is the inverse penalty of the summed loss."""
    n = max(train.count(), 1)
    stages = [
        VectorAssembler(inputCols=list(cols), outputCol="raw_features", handleInvalid="keep"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter),
    ]
    return Pipeline(stages=stages).fit(train)


def fit_rf(train: DataFrame, cols: Sequence[str], label: str, trees: int = 100, depth: int = 30, seed: int = 42) -> PipelineModel:
    """Random forest; 30 is the deepest that Spark grows, a leaf may end earlier. See ``forest``; runs at once."""
    return PipelineModel([VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="keep"), forest.fit(train, cols, label, trees, depth, seed)])


@dataclass(frozen=True)
class NewtonFit:
    """Coefficients and intercept of a penalised logistic regression, and the gradient left at them."""

    coefficients: dict[str, float]
    intercept: float
    gradient: dict[str, float]
    rounds: int

    def odds(self) -> str:
        return " + ".join([f"{self.intercept!r}D", *(f"{b!r}D * CAST(`{c}` AS DOUBLE)" for c, b in self.coefficients.items())])

    def pipeline(self) -> PipelineModel:
        """A stage that adds the probability ``p``; saved and loaded like any other."""
        return PipelineModel([SQLTransformer(statement=f"SELECT *, 1 / (1 + exp(-({self.odds()}))) AS p FROM __THIS__")])


def _newton_sums(rows: DataFrame, cols: Sequence[str], label: str, w: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature of the logistic loss at ``w``, intercept first; one short row per task is added up."""
    d = len(w)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + d + d * d)
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *(b.column(c).to_numpy(zero_copy_only=False) for c in cols)])
            y = b.column(label).to_numpy(zero_copy_only=False)
            z = x @ w
            p = 0.5 * (1 + np.tanh(z / 2))
            total[0] += (np.logaddexp(0, z) - y * z).sum()
            total[1 : d + 1] += x.T @ (p - y)
            total[d + 1 :] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

    doubles = rows.select(*[F.col(c).cast("double").alias(c) for c in (*cols, label)])
    out = np.zeros(1 + d + d * d)
    for r in doubles.mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def fit_newton(train: DataFrame, cols: Sequence[str], label: str, c: float = 1.0, tolerance: float = 1e-9, max_rounds: int = 100) -> NewtonFit:
    """L2-penalised logistic regression by Newton steps on sums over the rows; ``c`` is the inverse penalty of the summed loss.

    The intercept is not penalised. A step that does not lower the loss is halved. Ends when no
    gradient is over ``tolerance``. One job per round, whose result is as long as the features squared. Rows need
    all features; the table is read each round, so it should be a written one. Runs at once.
    """
    cols = list(cols)
    d = len(cols) + 1
    penalty = np.r_[0.0, np.full(d - 1, 1.0 / c)]
    w = np.zeros(d)

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        s = _newton_sums(train, cols, label, w)
        return s[0] + 0.5 * (penalty * w * w).sum(), s[1 : d + 1] + penalty * w, s[d + 1 :].reshape(d, d) + np.diag(penalty)

    loss, gradient, curve = at(w)
    rounds = 0
    while np.abs(gradient).max() > tolerance and rounds < max_rounds:
        step = np.linalg.lstsq(curve, gradient, rcond=None)[0]
        size = 1.0
        while rounds < max_rounds:
            rounds += 1
            new = at(w - size * step)
            # within rounding of the sum, a smaller gradient counts as well
            if new[0] < loss or (new[0] <= loss * (1 + 1e-13) and np.abs(new[1]).max() < np.abs(gradient).max()):
                break
            size /= 2
            if size < 1e-6:
                return _fit(cols, w, gradient, rounds)
        w = w - size * step
        loss, gradient, curve = new
    return _fit(cols, w, gradient, rounds)


def _fit(cols: Sequence[str], w: np.ndarray, gradient: np.ndarray, rounds: int) -> NewtonFit:
    left = dict(zip(["intercept", *cols], map(float, gradient)))
    return NewtonFit(dict(zip(cols, map(float, w[1:]))), float(w[0]), left, rounds)


def score_equations(train: DataFrame, fit: NewtonFit, label: str, c: float = 1.0) -> DataFrame:
    """(feature, gradient) of the penalised loss at a fit, from the rows alone; all are zero at the solution."""
    y = F.col(label).cast("double")
    left = fit.pipeline().transform(train).agg(
        F.sum(F.col("p") - y).alias("intercept"),
        *[(F.sum((F.col("p") - y) * F.col(f).cast("double")) + F.lit(b / c)).alias(f) for f, b in fit.coefficients.items()],
    )
    names = left.columns
    return left.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("gradient")) for n in names])))


def linear_terms(model: PipelineModel, cols: Sequence[str]) -> tuple[dict[str, float], float]:
    """Coefficient of each input and the intercept of a ``fit_lr`` model, for inputs before its scaler."""
    _, scaler, regression = model.stages
    slope = [b / s if s else 0.0 for b, s in zip(regression.coefficients.toArray(), scaler.std.toArray())]
    shift = sum(b * m for b, m in zip(slope, scaler.mean.toArray()))
    return {c: float(b) for c, b in zip(cols, slope)}, float(regression.intercept - shift)


def with_probability(scored: DataFrame) -> DataFrame:
    if "p" in scored.columns:
        return scored
    return scored.withColumn("p", vector_to_array("probability")[1])


def score_counts(pred: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives at each distinct score, with those at lower scores and in total."""
    y = F.col(label)
    hist = pred.filter(F.col(score).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("s")).agg(
        F.count(F.when(y == 1, 1)).alias("pos"), F.count(F.when(y == 0, 1)).alias("neg")
    )
    return running_totals(hist, by, "s", ["pos", "neg"])


def evaluate(pred: DataFrame, label: str, score: str = "p", by: Sequence[str] = (), threshold: float = 0.5) -> DataFrame:
    """ROC-AUC, average precision and the confusion metrics at a threshold, per group.

    Average precision sums precision over recall steps, without interpolation.
    """
    at = score_counts(pred, label, score, by)
    above = F.col("pos_total") - F.col("pos_before")  # true positives at this cut
    flagged = above + F.col("neg_total") - F.col("neg_before")
    wins = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)
    called = F.col("s") >= threshold
    sums = at.groupBy(*by).agg(
        F.max("pos_total").alias("positives"), F.max("neg_total").alias("negatives"),
        F.sum(wins).alias("wins"), F.sum(F.col("pos") * above / flagged).alias("precision_sum"),
        F.coalesce(F.sum(F.when(called, F.col("pos"))), F.lit(0)).alias("tp"), F.coalesce(F.sum(F.when(called, F.col("neg"))), F.lit(0)).alias("fp"),
    )
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("positives") - tp, F.col("negatives") - fp
    n = F.col("positives") + F.col("negatives")
    return sums.select(
        *by,
        (F.col("wins") / F.nullif(F.col("positives") * F.col("negatives"), F.lit(0))).alias("roc_auc"),
        (F.col("precision_sum") / F.nullif(F.col("positives"), F.lit(0))).alias("average_precision"),
        F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0)).alias("f1"),
        F.coalesce(tp / F.nullif(tp + fp, F.lit(0)), F.lit(0.0)).alias("precision"),
        F.coalesce(tp / F.nullif(tp + fn, F.lit(0)), F.lit(0.0)).alias("recall"),
        ((tp + tn) / n).alias("accuracy"),
        n.alias("rows"),
    )


def curve_points(pred: DataFrame, label: str, score: str = "p", by: Sequence[str] = ()) -> DataFrame:
    """ROC and precision-recall points at each distinct score."""
    at = score_counts(pred, label, score, by)
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    return at.select(
        *by, F.col("s").alias("threshold"),
        (tp / F.nullif(F.col("pos_total"), F.lit(0))).alias("tpr"), (fp / F.nullif(F.col("neg_total"), F.lit(0))).alias("fpr"),
        (tp / (tp + fp)).alias("precision"),
    )


def overfit_gap(metrics: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Train minus validation AUC and F1 per model."""

    def at(split: str, m: str):
        return F.max(F.when(F.col("split") == split, F.col(m)))

    return metrics.groupBy(*by).agg(
        (at("train", "roc_auc") - at("val", "roc_auc")).alias("auc_gap"), (at("train", "f1") - at("val", "f1")).alias("f1_gap")
    )


def best_model(metrics: DataFrame) -> DataFrame:
    """Model with the highest test AUC; the first name on ties."""
    test = metrics.filter("split = 'test'")
    return test.agg(F.min(F.struct(-F.coalesce("roc_auc", F.lit(-1.0)), "model"))["model"].alias("model"), F.max("roc_auc").alias("roc_auc"))


def model_metadata(model: PipelineModel, name: str, cols: Sequence[str], metrics: Mapping[str, float]) -> dict:
    return {"model": name, "stages": [type(s).__name__ for s in model.stages], "features": list(cols), **metrics}
