"""Replacement of tables and artefacts: whole or not at all."""

import tempfile

import pytest

from stayscope.operators import models, preparation
from stayscope.sources import versions


@pytest.fixture
def path():
    return tempfile.mkdtemp(prefix="run-test-") + "/layer"


def values(df):
    return sorted(r["v"] for r in df.select("v").collect())


def test_readers_keep_their_version_and_new_ones_follow(spark, path):
    assert versions.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        versions.read_published(spark, path)
    versions.replace_table(spark.range(3).selectExpr("id AS v"), path)
    old = versions.read_published(spark, path)
    # a table may be replaced by what is read from it
    versions.replace_table(old.selectExpr("v + 10 AS v"), path)
    assert values(old) == [0, 1, 2] and values(versions.read_published(spark, path)) == [10, 11, 12]
    assert versions.latest(spark, path) == 2


def test_a_writer_that_dies_leaves_the_old_rows(spark, path):
    versions.replace_table(spark.range(3).selectExpr("id AS v"), path)
    failing = spark.range(1000).selectExpr("CASE WHEN id = 999 THEN raise_error('lost') ELSE id END AS v")
    with pytest.raises(Exception, match="lost"):
        versions.replace_table(failing, path)
    spark.range(9).selectExpr("id AS v").write.parquet(versions.stage(path))  # written, never published
    assert values(versions.read_published(spark, path)) == [0, 1, 2]
    assert versions.drop_versions(spark, path) == []
    assert len(versions.drop_versions(spark, path, abandoned=True)) >= 1
    assert values(versions.read_published(spark, path)) == [0, 1, 2]


def test_of_two_writers_one_is_told(spark, path):
    versions.replace_table(spark.range(1).selectExpr("id AS v"), path)
    before = versions.latest(spark, path)
    mine = versions.stage(path)
    spark.range(5).selectExpr("id AS v").write.parquet(mine)
    versions.replace_table(spark.range(2).selectExpr("id AS v"), path)  # the other is faster
    with pytest.raises(versions.Conflict):
        versions.publish(spark, path, mine, before)
    assert values(versions.read_published(spark, path)) == [0, 1]


def test_old_versions_go_on_demand(spark, path):
    for n in range(1, 6):
        versions.replace_table(spark.range(n).selectExpr("id AS v", "id % 2 AS part"), path, ["part"])
    assert len(versions.drop_versions(spark, path, keep=2)) == 3
    assert values(versions.read_published(spark, path)) == [0, 1, 2, 3, 4] and versions.latest(spark, path) == 5
    assert versions.drop_versions(spark, path, keep=2) == []
    with pytest.raises(ValueError):
        versions.drop_versions(spark, path, keep=0)


def test_preparation_is_fitted_to_training_rows_and_saved_with_the_models(spark, path):
    rows = [(1, 2.0, "b", None, 0), (2, None, "a", 1.0, 1), (3, 4.0, None, 3.0, 0), (4, 9.0, "it's \\\\ odd", 8.0, 1)]
    train = spark.createDataFrame(rows, "id int, x double, phase string, z double, y int")
    new = spark.createDataFrame([(5, None, "c", 2.0, 0), (6, 4.0, "it's \\\\ odd", None, 1)], train.schema)
    made = preparation.fit_preparation(train, ["x", "z"], ["phase"])
    got = {r["id"]: r for r in made.transform(new).collect()}
    # medians 4 and 3; then means 4.75 and 3.75
    sx = (sum((v - 4.75) ** 2 for v in (2, 4, 4, 9)) / 4) ** 0.5
    sz = (sum((v - 3.75) ** 2 for v in (3, 1, 3, 8)) / 4) ** 0.5
    assert got[5]["x"] == pytest.approx((4 - 4.75) / sx) and got[6]["z"] == pytest.approx((3 - 3.75) / sz)
    assert got[5]["phase_encoded"] is None and got[6]["phase_encoded"] == 2.0
    prepared = made.transform(train)
    fits = {"lr": models.fit_lr(prepared, ["x", "z"], "y", max_iter=20), "newton": models.fit_newton(prepared, ["x", "z"], "y").pipeline()}
    artefact = preparation.Artefact(made, fits, {"features": ["x", "z"]})
    preparation.save_artefact(artefact, path)
    found = preparation.load_artefact(spark, path)
    assert found.metadata == {"features": ["x", "z"]} and sorted(found.models) == ["lr", "newton"]
    for name in fits:
        p, q = ([r["p"] for r in models.with_probability(a.predict(new, name)).orderBy("id").collect()] for a in (artefact, found))
        assert p == q
    preparation.save_artefact(preparation.Artefact(made, {}, {"n": 2}), path)
    assert preparation.load_artefact(spark, path).models == {} and versions.latest(spark, path) == 2


def test_a_constant_and_an_empty_column_can_be_prepared(spark):
    train = spark.createDataFrame([(1.0, None, None), (1.0, None, None)], "a double, b double, c string")
    row = preparation.fit_preparation(train, ["a", "b"], ["c"]).transform(train).first()
    assert row["a"] == 0.0 and row["b"] is None and row["c_encoded"] is None
