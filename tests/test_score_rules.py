"""Score boundaries of both rule sets, gaps included."""

import pytest
from pyspark.sql import functions as F

from stayscope.functions import policy_scores, sofa_rules as r


def values(spark, rows, schema, column):
    return [x[0] for x in spark.createDataFrame(rows, schema).select(column).collect()]


def test_enhanced_respiratory_follows_branch_order(spark):
    rows = [(None, False), (450.0, False), (200.0, True), (199.0, False), (199.0, True), (100.0, False), (99.0, True), (99.0, False)]
    got = values(spark, rows, "ratio double, vent boolean", r.enhanced_respiratory(F.col("ratio"), F.col("vent")))
    assert got == [0, 2, 2, 3, 0, 3, 4, 0]


def test_table_respiratory(spark):
    rows = [(None, False), (400.0, False), (399.9, False), (300.0, False), (299.0, False), (200.0, True), (150.0, True), (150.0, False), (99.0, True), (99.0, False)]
    got = values(spark, rows, "ratio double, vent boolean", r.table_respiratory(F.col("ratio"), F.col("vent")))
    assert got == [None, 0, 1, 1, 2, 2, 3, 2, 4, 3]


@pytest.mark.parametrize(
    "fn,cases",
    [
        (r.table_liver, {1.1: 0, 1.2: 1, 1.9: 1, 1.95: 0, 2.0: 2, 5.9: 2, 5.95: 0, 6.0: 3, 11.95: 0, 12.0: 4}),
        (r.table_cns, {15.0: 0, 14.5: 0, 14.0: 1, 13.0: 1, 12.5: 0, 12.0: 2, 9.5: 0, 6.0: 3, 5.9: 4, 3.0: 4}),
        (r.table_coagulation, {150.0: 0, 149.0: 1, 100.0: 1, 99.0: 2, 50.0: 2, 49.0: 3, 20.0: 3, 19.0: 4}),
        (r.enhanced_hepatic, {1.1: 0, 1.2: 1, 1.95: 1, 2.0: 2, 6.0: 3, 12.0: 4}),
        (r.enhanced_coagulation, {19.0: 4, 20.0: 3, 50.0: 2, 100.0: 1, 150.0: 0}),
        (r.enhanced_neurological, {5.0: 4, 6.0: 3, 9.0: 3, 10.0: 2, 12.0: 2, 14.0: 1, 15.0: 0}),
    ],
)
def test_single_value_scores(spark, fn, cases):
    got = values(spark, [(v,) for v in cases], "v double", fn(F.col("v")))
    assert got == list(cases.values())


def test_null_scores(spark):
    none = F.lit(None).cast("double")
    row = spark.range(1).select(
        r.table_liver(none), r.table_cns(none), r.table_renal(none, none), r.enhanced_hepatic(none), r.enhanced_renal(none, none)
    ).first()
    assert list(row) == [None, None, None, 0, 0]


def test_renal(spark):
    rows = [(1.0, None), (1.95, None), (3.45, None), (4.95, None), (5.0, None), (1.0, 199.0), (1.0, 200.0), (1.0, 500.0), (None, 450.0), (None, 600.0)]
    table = values(spark, rows, "c double, u double", r.table_renal(F.col("c"), F.col("u")))
    assert table == [0, 0, 0, 0, 4, 4, 3, 0, 3, 0]
    enhanced = values(spark, rows, "c double, u double", r.enhanced_renal(F.col("c"), F.col("u")))
    assert enhanced == [0, 1, 2, 3, 4, 4, 3, 0, 3, 0]


def test_cardiovascular(spark):
    rows = [
        (60.0, 10.0, None, None, None, 3), (60.0, None, None, None, None, 1), (70.0, None, None, None, None, 0),
        (None, None, None, None, None, None), (None, 16.0, None, None, None, 4), (80.0, None, 0.05, None, None, 3),
        (80.0, None, None, 0.2, None, 4), (80.0, 5.0, None, None, None, 2), (80.0, None, None, None, 1.0, 2),
    ]
    schema = "m double, da double, ep double, ne double, db double, want int"
    got = values(spark, rows, schema, r.table_cardiovascular(*[F.col(c) for c in ("m", "da", "ep", "ne", "db")]))
    assert got == [x[5] for x in rows]
    top = values(spark, [(60.0, 15.0), (60.0, 5.0), (60.0, 0.1), (60.0, None), (None, None)], "m double, d double", r.enhanced_cardiovascular(F.col("m"), F.col("d")))
    assert top == [4, 3, 2, 1, 0]


def test_total_missing_and_severity(spark):
    known = {n: F.lit(v) for n, v in zip(r.COMPONENTS, (3, 2, 1, 0, 1, 2))}
    row = spark.range(1).select(r.total_score(known), r.missing_components(known), r.severity(r.total_score(known))).first()
    assert list(row) == [9, [], "Moderate"]
    some = dict(known, liver=F.lit(None).cast("int"))
    assert spark.range(1).select(r.missing_components(some)).first()[0] == ["liver"]


def test_oxygen_fraction_accepts_percent_and_fraction(spark):
    got = values(spark, [(0.5,), (50.0,), (0.0,), (1.0,)], "f double", r.oxygen_ratio(F.lit(100.0), F.col("f")))
    assert got == [200.0, 200.0, None, 100.0]


def test_policy_scores_ignore_missing(spark):
    df = spark.createDataFrame([(None, 160.0, 4.0, 36.0), (60.0, None, None, None)], "paco2 double, heart_rate double, creatinine double, respiratory_rate double")
    full = [tuple(x) for x in df.select(*[policy_scores.score(s) for s in policy_scores.SCORES]).collect()]
    assert full == [(7, 7, 10, 4), (3, 0, 0, 0)]
    simple = [tuple(x) for x in df.select(*[policy_scores.score(s, "simple") for s in policy_scores.SCORES]).collect()]
    assert simple == [(12, 7, 4, 3), (0, 0, 0, 0)]
