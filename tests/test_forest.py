"""The forest against growing by recursion, and its independence of where cells lie."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from stayscope.operators import forest, models

COLS = ["a", "b", "c", "e"]


def table(spark, n=400, parts=5):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 4))
    x[:, 1], x[:, 2] = rng.integers(0, 4, n), np.round(x[:, 2], 1)
    x[n // 2 :] = x[: n - n // 2]  # every row twice, in part with another label
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=n) > 0.8).astype(int)
    pdf = pd.DataFrame(x, columns=COLS).assign(y=y, k=np.arange(n))
    df = spark.createDataFrame(pdf).repartition(parts, "k")
    return df.withColumn("e", F.when(F.col("k") % 11 != 3, F.col("e")))


def chances(model, df):
    rows = models.with_probability(model.transform(df)).select("k", "p").collect()
    assert len(rows) == df.count()
    return np.array([r["p"] for r in sorted(rows, key=lambda r: r["k"])])


def gini(w):
    return 1 - ((w.sum(0) / max(w.sum(), 1)) ** 2).sum()


def by_recursion(cells, w, asked, tree, node, seed, q, depth):
    """Leaf weights of the asked cells, whether it is one leaf, and all weights."""
    total, best = w.sum(0), (0.0, None, None)
    if node.bit_length() - 1 < depth and gini(w) > 0:
        for f in forest._choice(seed, tree, np.array([node]), cells.shape[1], q)[0]:
            for cut in range(31):
                low = cells[:, f] <= cut
                n = (w[low].sum(), w[~low].sum())
                if min(n) > 0:
                    gain = gini(w) - n[0] / w.sum() * gini(w[low]) - n[1] / w.sum() * gini(w[~low])
                    best = max(best, (gain, f, cut), key=lambda x: x[0])
    if best[1] is None:
        return np.tile(total, (len(asked), 1)), True, total
    out, sides = np.zeros((len(asked), 2)), []
    for side in (0, 1):
        mine, theirs = (cells[:, best[1]] > best[2]) == side, (asked[:, best[1]] > best[2]) == side
        out[theirs], leaf, below = by_recursion(cells[mine], w[mine], asked[theirs], tree, 2 * node + side, seed, q, depth)
        sides.append((leaf, below.argmax()))
    if sides[0] == sides[1] and sides[0][0]:
        return np.tile(total, (len(asked), 1)), True, total
    return out, False, total


@pytest.mark.parametrize("local", [1 << 19, 30])
def test_forest_is_that_of_growing_by_recursion(spark, monkeypatch, local):
    monkeypatch.setattr(forest, "_LOCAL", local)
    monkeypatch.setattr(forest, "_BLOCK", 64)
    df = table(spark)
    model = models.fit_rf(df, COLS, "y", trees=6, depth=7, seed=5)
    grown = model.stages[1]
    assert (grown.tops is None) == (local > 400)
    pdf = df.toPandas().sort_values("k")
    places = np.stack([np.searchsorted(c, pdf[f].to_numpy(float)) for f, c in zip(COLS, grown.cuts)], 1).astype(np.uint8)
    cells, back = np.unique(places, axis=0, return_inverse=True)
    counts = np.stack([np.bincount(back.ravel(), pdf["y"] == c, len(cells)) for c in (0, 1)], 1).astype(int)
    want = np.zeros(len(places))
    for tree in range(6):
        w = forest._Draws(cells, counts, 5).of(tree)
        leaf = by_recursion(cells[w.any(axis=1)], w[w.any(axis=1)], places, tree, 1, 5, 2, 7)[0]
        want += leaf[:, 1] / leaf.sum(1) / 6
    assert chances(model, df) == pytest.approx(want, abs=1e-12)


def test_weights_are_poisson_of_the_counts():
    rng = np.random.default_rng(0)
    cells = rng.integers(0, 32, (40_000, 9)).astype(np.uint8)
    counts = np.stack([np.repeat([1, 5], 20_000), np.repeat([0, 3000], 20_000)], 1)
    w = forest._Draws(cells, counts, 42).of(7)
    for part, mean in ((w[:20_000, 0], 1), (w[20_000:, 0], 5), (w[20_000:, 1], 3000)):
        assert part.mean() == pytest.approx(mean, rel=0.03) and part.var() == pytest.approx(mean, rel=0.05)
    assert not w[:20_000, 1].any()


def test_forest_does_not_depend_on_partitions_and_is_saved(spark, tmp_path):
    df = table(spark)
    model = models.fit_rf(df, COLS, "y", trees=10)
    p = chances(model, df)
    assert p == pytest.approx(chances(models.fit_rf(table(spark, parts=3).orderBy("a"), COLS, "y", trees=10), df), abs=1e-12)
    model.write().save(str(tmp_path / "model"))
    assert p == pytest.approx(chances(PipelineModel.load(str(tmp_path / "model")), df), abs=1e-12)
    out = model.transform(df).select("prediction", "probability", "rawPrediction", "features").first()
    assert out["rawPrediction"].toArray() == pytest.approx(out["probability"].toArray() * 10)
    assert out["prediction"] == out["probability"].toArray().argmax() and len(out["features"]) == 4


def test_forest_learns_and_no_nodes_reach_the_driver(spark):
    df = table(spark, 3000)
    model = models.fit_rf(df.filter("k < 1500"), COLS, "y", trees=40)
    scored = models.with_probability(model.transform(df.filter("k >= 1500"))).select("y", "p")
    assert models.evaluate(scored, "y").first()["roc_auc"] > 0.75
    assert model.stages[1].tops is None and model.stages[1].parts.count() == 40


@pytest.mark.parametrize("label", [0, 1])
@pytest.mark.parametrize("local", [1 << 19, 30])
def test_one_class_alone(spark, monkeypatch, label, local):
    monkeypatch.setattr(forest, "_LOCAL", local)
    df = table(spark, 100).withColumn("y", F.lit(label))
    assert set(chances(models.fit_rf(df, COLS, "y", trees=3), df)) == {float(label)}


def test_labels_that_are_no_classes(spark):
    df = table(spark, 20)
    for bad in (F.lit(0.5), F.when(F.col("k") > 3, 1), F.lit(-1)):
        with pytest.raises(ValueError, match="whole numbers"):
            models.fit_rf(df.withColumn("y", bad), COLS, "y", trees=2)
