"""Statistics, neighbours and evaluation against known numbers."""

import math
import random

import numpy as np
import pytest

from stayscope.functions import tails
from stayscope.operators import explain, models, neighbours, stats


def test_tail_probabilities():
    assert tails.student_two_sided(2.0, 10) == pytest.approx(0.0733880347707, abs=1e-10)
    assert tails.student_two_sided(1.0, 1) == pytest.approx(0.5, abs=1e-12)
    assert tails.student_two_sided(12.706204736, 1) == pytest.approx(0.05, abs=1e-8)
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-12)


def pairs(spark, a, b):
    rows = [(float(x), float(y)) for x, y in zip(a, b)]
    df = spark.createDataFrame(rows, "sofa_score_config1 double, sofa_score_config2 double")
    return stats.joint_counts(df, ["sofa_score"])


def test_wilcoxon_and_spearman_small_example(spark):
    a, b = [1.0, 2, 3, 4, 5, 6, 7, 9], [2.0, 2, 1, 5, 3, 9, 7, 5]
    hist = pairs(spark, a, b)
    row = stats.wilcoxon(hist).first()
    d = [x - y for x, y in zip(a, b) if x != y]
    sizes = sorted(abs(v) for v in d)
    rank = {v: np.mean([i + 1 for i, s in enumerate(sizes) if s == v]) for v in sizes}
    up, down = sum(rank[abs(v)] for v in d if v > 0), sum(rank[abs(v)] for v in d if v < 0)
    assert row["wilcoxon_statistic"] == min(up, down)
    m, tie = len(d), sum(t**3 - t for t in (sizes.count(v) for v in set(sizes)))
    assert row["wilcoxon_z"] == pytest.approx((min(up, down) - m * (m + 1) / 4) / math.sqrt(m * (m + 1) * (2 * m + 1) / 24 - tie / 48))

    def ranks(v):
        s = sorted(v)
        return [np.mean([i + 1 for i, q in enumerate(s) if q == w]) for w in v]

    want = np.corrcoef(ranks(a), ranks(b))[0, 1]
    assert stats.spearman(hist).first()["correlation_spearman"] == pytest.approx(want)


def test_constant_side_gives_null_correlation(spark):
    hist = pairs(spark, [1.0] * 12, [float(i) for i in range(12)])
    assert stats.spearman(hist).first()["correlation_spearman"] is None


def test_mann_whitney(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", 4), ("b", 5)], "g string, v int")
    row = stats.mann_whitney(df, "g", "a", "v").first()
    assert row["u_statistic"] == 1.5 and (row["n1"], row["n2"]) == (3, 3)
    assert 0.0 < row["p_value"] < 1.0


def test_average_precision_is_not_interpolated(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.6), (1, 0.2)]
    row = models.evaluate(spark.createDataFrame(rows, "y int, p double"), "y").first()
    assert row["average_precision"] == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    assert row["roc_auc"] == pytest.approx(3 / 6)
    assert (row["accuracy"], row["precision"], row["recall"]) == (pytest.approx(2 / 5), pytest.approx(0.5), pytest.approx(2 / 3))


def test_scaling_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (3.0,)], "v double")
    got = sorted(r["v"] for r in models.scale_columns(df, df, ["v"]).collect())
    assert got == pytest.approx([-math.sqrt(1.5), 0.0, math.sqrt(1.5)])


@pytest.mark.parametrize("block", [40, 4096])
def test_nearest_is_exact_across_blocks(spark, block):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    x[100:200] = x[100]  # a third of the rows are the same point
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")
    got = {}
    for r in neighbours.nearest(df, 3, block_rows=block).collect():
        got.setdefault(r["id"], []).append(r["d"])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :3]
    for i in range(300):
        assert sorted(got[i]) == pytest.approx(list(want[i]), abs=1e-9)


def test_near_neighbours_recall_and_linear_work(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(4000, 8))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")
    got = {}
    for r in neighbours.near_neighbours(df, 3).collect():
        got.setdefault(r["id"], set()).add(r["other"])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = np.argsort(d, axis=1)[:, :3]
    assert np.mean([len(got[i] & set(want[i].tolist())) / 3 for i in range(4000)]) > 0.8
    assert all(len(v) == 3 for v in got.values())


@pytest.mark.parametrize("n", [3000, 12000])
def test_near_neighbours_miss_nothing_as_rows_grow_denser(spark, n):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 8))
    x[:300] = x[0]  # equal points have each other, by least id
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>")
    got = neighbours.near_neighbours(df, 3).toPandas().sort_values(["id", "position"])
    assert len(got) == 3 * n
    found = got["other"].to_numpy().reshape(n, 3)
    assert found[0].tolist() == [1, 2, 3] and found[299].tolist() == [0, 1, 2]
    asked = np.r_[0:20, rng.choice(np.arange(300, n), 500, replace=False)]
    d = ((x[asked][:, None] - x[None]) ** 2).sum(2)
    d[np.arange(len(asked)), asked] = np.inf
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert found[asked].tolist() == want.tolist()


def brute_nearest(x, k):
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return [sorted(zip(row, range(len(x))))[:k] for row in d]


@pytest.mark.parametrize("features,spread", [(8, 1.0), (20, 1.0), (20, 0.02), (3, 0.0)])
def test_nearest_in_many_dimensions(spark, monkeypatch, features, spread):
    monkeypatch.setattr(neighbours, "_FAN", 3)
    monkeypatch.setattr(neighbours, "_GROUPS", 4)
    monkeypatch.setattr(neighbours, "_ROWS", 50)
    rng = np.random.default_rng(features)
    centres = rng.normal(size=(9, features))
    x = np.round(centres[rng.integers(0, 9, 700)] + spread * rng.normal(size=(700, features)), 3)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, x array<double>").repartition(6)
    got = {}
    for r in neighbours.nearest(df, 4, block_rows=40).collect():
        got.setdefault(r["id"], []).append((r["d"], r["other"]))
    want = brute_nearest(x, 4)
    assert [sorted(got[i]) == [(pytest.approx(d), o) for d, o in w] for i, w in enumerate(want)] == [True] * len(x)


def test_smote_balances_and_stays_between_neighbours(spark):
    rng = random.Random(2)
    rows = [(i, 1 if i % 9 == 0 else 0, rng.gauss(i % 9 == 0, 1), rng.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "id0 int, y int, a double, b double")
    out = models.smote(df, ["a", "b"], "y", ["id0"]).toPandas()
    assert (out["y"] == 1).sum() == (out["y"] == 0).sum()
    real, made = out[(out["y"] == 1) & ~out["synthetic"]], out[out["synthetic"]]
    assert made["a"].between(real["a"].min(), real["a"].max()).all()


def test_smote_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(i, int(i < 10), rng.random(), rng.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "id0 int, y int, a double, b double")
    made = {}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (8, 200):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            out = models.smote(df, ["a", "b"], "y", ["id0"]).toPandas()
            assert (out["y"] == 1).sum() == (out["y"] == 0).sum() == 50
            made[parts] = sorted(map(tuple, out[out["synthetic"]][["id0", "a", "b"]].to_numpy().tolist()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert made[8] == made[200]


def test_sampled_contributions_add_up(spark):
    rng = random.Random(6)
    rows = [(i, rng.random(), rng.random(), 0) for i in range(120)]
    rows = [(i, a, b, int(a + 0.5 * b > 0.8)) for i, a, b, _ in rows]
    df = spark.createDataFrame(rows, "k int, a double, b double, y int")
    model = models.fit_lr(df, ["a", "b"], "y", max_iter=50)
    sample = models.sample_rows(df, 5, ["k"])
    parts = explain.sampled_contributions(sample, model, ["a", "b"], ["k"], df, m=4).toPandas()
    assert len(parts) == 10
    scored = models.with_probability(model.transform(df)).toPandas().set_index("k")["p"]
    chosen_mean = (scored.loc[parts["k"].unique()] - parts.groupby("k")["contribution"].sum()).round(6)
    assert chosen_mean.nunique() == 1  # the same background mean for every row
