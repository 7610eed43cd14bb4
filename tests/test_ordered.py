"""Distributed ordering operators against brute force."""

import random

import numpy as np
import pandas as pd
import pytest

from stayscope.operators import ordered


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    rows = [("hot", round(rng.gauss(0, 50), 2)) for _ in range(3000)] + [("few", float(v)) for v in (1, 2, 4, 8)]
    rows += [("one", 7.0), ("wide", -1e9), ("wide", 3.0), ("wide", 1e9), (None, 2.0), (None, 4.0)]
    return rows, spark.createDataFrame(rows, "g string, v double").repartition(7)


def test_quantiles_match_numpy(numbers):
    rows, df = numbers
    probs = {"p05": 0.05, "q1": 0.25, "mid": 0.5, "p95": 0.95}
    got = {r["g"]: r for r in ordered.exact_quantiles(df, ["g"], "v", probs).collect()}
    for g in ("hot", "few", "one", "wide", None):
        vals = [v for k, v in rows if k == g]
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(vals, p))


def test_quantiles_without_groups(numbers):
    rows, df = numbers
    got = ordered.exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert got == pytest.approx(np.median([v for _, v in rows]))


@pytest.mark.parametrize("few", [1, 50, 1 << 16])
def test_quantiles_in_any_number_of_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(ordered, "_FEW_ROWS", few)
    monkeypatch.setattr(ordered, "_STEPS", 8)
    rng = random.Random(few)
    groups = {
        "close": [1e9 + rng.random() for _ in range(2000)], "epochs": [1.7e15 + rng.randrange(10**9) for _ in range(500)],
        "tiny": [rng.choice((-1, 1)) * 1e-13 * rng.random() for _ in range(300)], "tied": [5.0] * 900 + [5.0 + 1e-9] * 2,
        "ends": [-1e300, 1e300, 0.0, -0.0, 5e-324], None: [3.0, 3.0 + 2**-51], "one": [7.25],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    probs = {"least": 0.0, "q1": 0.25, "mid": 0.5, "p999": 0.999, "most": 1.0}
    got = {r["g"]: r for r in ordered.exact_quantiles(df, ["g"], "v", probs, count="n").collect()}
    assert len(got) == len(groups)
    for g, vs in groups.items():
        vs, r = sorted(vs), got[g]
        assert r["n"] == len(vs)
        for name, p in probs.items():
            at = p * (len(vs) - 1)
            low, high = vs[int(np.floor(at))], vs[int(np.ceil(at))]
            assert r[name] == low + (high - low) * (at - np.floor(at))


def test_quantiles_of_many_groups_are_written(spark, monkeypatch):
    monkeypatch.setattr(ordered, "_SMALL", 10)
    rows = [(i % 97, float(i * i % 1013)) for i in range(5000)]
    got = {r["g"]: r["m"] for r in ordered.exact_quantiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", {"m": 0.5}).collect()}
    assert got == {g: np.median([v for k, v in rows if k == g]) for g in range(97)}
    assert ordered.exact_quantiles(spark.createDataFrame([], "g int, v double"), ["g"], "v", {"m": 0.5}).count() == 0


def test_running_totals_of_one_large_group_take_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hist = spark.range(20_000).selectExpr("cast(null AS string) g", "cast(id * 37 % 20000 AS double) v", "id * 37 % 20000 % 7 AS n")
        out = ordered.running_totals(hist, ["g"], "v", ["n"])
        got = sorted((r["v"], r["n_before"], r["n_total"]) for r in out.collect())
        n = np.arange(20_000) % 7
        assert [b for _, b, _ in got] == (np.cumsum(n) - n).tolist() and {t for *_, t in got} == {n.sum()}
        parts = {r["p"]: r["count"] for r in out.groupBy(ordered.F.spark_partition_id().alias("p")).count().collect()}
        assert len(parts) >= 4 and max(parts.values()) < 12_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_average_ranks(spark):
    df = spark.createDataFrame([(v,) for v in (1, 1, 5, -3, 5, 5)], "v int")
    got = {r["v"]: r["rank"] for r in ordered.average_ranks(df, "v").collect()}
    assert got == {-3: 1.0, 1: 2.5, 5: 5.0}


def test_global_positions(spark):
    df = spark.range(5000).selectExpr("id % 3 AS a", "id AS b").repartition(6)
    got = sorted((r["a"], r["b"], r["position"]) for r in ordered.global_positions(df, ["a", "b"]).collect())
    assert [g[2] for g in got] == list(range(1, 5001))


def test_carry_forward_crosses_buckets(spark):
    rng = random.Random(5)
    rows = []
    for k in (1, 2, 3):
        for t in sorted(rng.sample(range(2000), 60)):
            rows.append((k, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=t), rng.random() if rng.random() < 0.3 else None))
    pdf = pd.DataFrame(rows, columns=["k", "t", "v"])
    df = spark.createDataFrame([(k, t.to_pydatetime(), v) for k, t, v in rows], "k int, t timestamp_ntz, v double").repartition(4)
    got = ordered.carry_forward(df, ["k"], ["t"], "t", ["v"], bucket_hours=24).toPandas().sort_values(["k", "t"])
    want = pdf.groupby("k")["v"].ffill()
    np.testing.assert_array_equal(got["v"].to_numpy(dtype=float), want.to_numpy(dtype=float))


def test_asof_against_brute_force(spark):
    rng = random.Random(8)
    base = pd.Timestamp("2024-01-01")
    events = [(rng.choice("ab"), base + pd.Timedelta(minutes=rng.randrange(6000)), float(i)) for i in range(300)]
    probes = [(rng.choice("abc"), base + pd.Timedelta(minutes=rng.randrange(6000)), i) for i in range(120)]
    probes.append((events[0][0], events[0][1], 999))  # same instant as an event
    e = spark.createDataFrame([(k, t.to_pydatetime(), v, int(v)) for k, t, v in events], "k string, at timestamp_ntz, v double, tie int")
    p = spark.createDataFrame([(k, t.to_pydatetime(), i) for k, t, i in probes], "k string, t timestamp_ntz, i int")
    got = {r["i"]: r["v"] for r in ordered.asof_backward(p, e, ["k"], "t", "at", "v", 5.0, tie="tie").collect()}
    assert len(got) == len(probes)
    for k, t, i in probes:
        hits = [(at, v) for kk, at, v in events if kk == k and t - pd.Timedelta(hours=5) <= at < t]
        assert got[i] == (max(hits)[1] if hits else None)


def test_interval_join_includes_both_ends_and_touching_spans(spark):
    spans = spark.createDataFrame(
        [(1, 10, "2024-01-01 00:00:00", "2024-01-03 12:00:00"), (1, 11, "2024-01-03 12:00:00", "2024-01-05 00:00:00")],
        "k int, stay int, lo string, hi string",
    ).selectExpr("k", "stay", "cast(lo AS timestamp_ntz) lo", "cast(hi AS timestamp_ntz) hi")
    events = spark.createDataFrame(
        [(1, 1, "2024-01-01 00:00:00"), (1, 2, "2024-01-03 12:00:00"), (1, 3, "2024-01-05 00:00:00"), (1, 4, "2024-01-05 00:00:01"), (2, 5, "2024-01-02 00:00:00")],
        "k int, e int, t string",
    ).selectExpr("k", "e", "cast(t AS timestamp_ntz) t")
    got = sorted((r["e"], r["stay"]) for r in ordered.interval_join(events, spans, "k", "t", "lo", "hi").collect())
    assert got == [(1, 10), (2, 10), (2, 11), (3, 11)]
