"""Fitted models against independent solutions, and explanations with their errors."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer

from stayscope.operators import explain, models


def logistic_rows(n, d, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * scale
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ np.arange(1, d + 1) / d - 0.5)))).astype(int)
    return x, y


def frame(spark, x, y):
    cols = [f"f{i}" for i in range(x.shape[1])]
    rows = [(*map(float, v), int(t)) for v, t in zip(x, y)]
    return cols, spark.createDataFrame(rows, ", ".join([f"{c} double" for c in cols] + ["y int"])).repartition(5)


def plain_newton(x, y, c, rounds=60):
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.r_[0.0, np.full(x.shape[1] - 1, 1 / c)]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
    return w


@pytest.mark.parametrize("n,d,c", [(300, 3, 1.0), (400, 6, 0.01), (60, 2, 100.0)])
def test_newton_solves_the_score_equations(spark, n, d, c):
    x, y = logistic_rows(n, d, n)
    cols, df = frame(spark, x, y)
    fit = models.fit_newton(df, cols, "y", c=c)
    want = plain_newton(x, y, c)
    assert fit.intercept == pytest.approx(want[0], abs=1e-7) and list(fit.coefficients.values()) == pytest.approx(list(want[1:]), abs=1e-7)
    assert max(abs(g) for g in fit.gradient.values()) < 1e-8
    left = {r["feature"]: r["gradient"] for r in models.score_equations(df, fit, "y", c).collect()}
    assert set(left) == {"intercept", *cols} and max(map(abs, left.values())) < 1e-7


def test_newton_agrees_with_the_first_order_solver(spark):
    x, y = logistic_rows(500, 3, 7)
    x = (x - x.mean(0)) / x.std(0, ddof=1)
    cols, df = frame(spark, x, y)
    slope, intercept = models.linear_terms(models.fit_lr(df, cols, "y"), cols)
    fit = models.fit_newton(df, cols, "y")
    assert fit.intercept == pytest.approx(intercept, abs=1e-3)
    assert [fit.coefficients[c] for c in cols] == pytest.approx([slope[c] for c in cols], abs=1e-3)


def test_newton_halves_steps_and_bears_twin_columns(spark):
    x, y = logistic_rows(80, 1, 3, scale=40.0)  # nearly separable, large values: a full first step overshoots
    cols, df = frame(spark, np.column_stack([x, x]), y)
    fit = models.fit_newton(df, cols, "y")
    assert max(abs(g) for g in fit.gradient.values()) < 1e-6
    assert fit.coefficients["f0"] == pytest.approx(fit.coefficients["f1"])
    one = models.fit_newton(df.filter("y = 1"), cols[:1], "y", max_rounds=30)
    assert math.isfinite(one.intercept) and one.rounds <= 30


def formula():
    return PipelineModel([SQLTransformer(statement="SELECT *, 1 / (1 + exp(-(a * b + 2 * c * a - b))) AS p FROM __THIS__")])


COLS = ["a", "b", "c"]


def plain(v):
    a, b, c = v
    return 1 / (1 + math.exp(-(a * b + 2 * c * a - b)))


def shapley(x, background):
    out = np.zeros(3)
    for z in background:
        for order in itertools.permutations(range(3)):
            v = list(z)
            for i in order:
                before = plain(v)
                v[i] = x[i]
                out[i] += plain(v) - before
    return out / len(background) / 6


@pytest.fixture(scope="module")
def explained(spark):
    rng = np.random.default_rng(16)
    x, z = rng.normal(size=(6, 3)).round(2), rng.normal(size=(10, 3)).round(2)
    schema = "id int, a double, b double, c double"
    rows = lambda m: spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(m)], schema).repartition(3)
    return x, z, rows(x), rows(z)


def test_contributions_add_up_and_come_with_their_error(spark, explained):
    x, z, df, background = explained
    got = explain.sampled_contributions(df, formula(), COLS, ["id"], background, m=40).collect()
    by = {(r["id"], r["feature"]): r for r in got}
    assert len(by) == 18 and {r["draws"] for r in got} == {40}
    off = []
    for i, v in enumerate(x):
        rows = [by[i, c] for c in COLS]
        assert sum(r["contribution"] for r in rows) + rows[0]["base"] == pytest.approx(plain(v), abs=1e-12)
        assert rows[1]["base"] == pytest.approx(rows[0]["base"]) == rows[2]["base"]
        off += [(r["contribution"] - w) / r["standard_error"] for r, w in zip(rows, shapley(v, z))]
    # the errors say how far off the contributions are
    assert np.mean(np.square(off)) < 4 and max(map(abs, off)) < 6


def test_contributions_are_drawn_until_the_error(spark, explained):
    x, z, df, background = explained
    loose = explain.sampled_contributions(df, formula(), COLS, ["id"], background, m=8, error=0.04, max_rounds=40).collect()
    assert max(r["standard_error"] for r in loose) <= 0.04
    draws = {r["id"]: r["draws"] for r in loose}
    assert len(set(draws.values())) > 1 and min(draws.values()) >= 8  # rows that are sure need fewer
    want = {(i, c): w for i, v in enumerate(x) for c, w in zip(COLS, shapley(v, z))}
    assert all(abs(r["contribution"] - want[r["id"], r["feature"]]) < 0.1 for r in loose)


def test_pairs_cancel_the_order_of_a_product(spark):
    # of x1 * x2 between two points, each order alone is off and both together are exact
    model = PipelineModel([SQLTransformer(statement="SELECT *, a * b AS p FROM __THIS__")])
    df = spark.createDataFrame([(1, 3.0, 5.0)], "id int, a double, b double")
    got = {r["feature"]: r for r in explain.sampled_contributions(df, model, ["a", "b"], ["id"], spark.createDataFrame([(0, 1.0, 2.0)], df.schema), m=3).collect()}
    assert got["a"]["contribution"] == pytest.approx(7.0) and got["b"]["contribution"] == pytest.approx(6.0)
    assert got["a"]["standard_error"] == pytest.approx(0.0) and got["a"]["base"] == pytest.approx(2.0)
