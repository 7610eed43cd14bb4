"""Readers, sinks and the streaming rows."""

import json
import tempfile

from pyspark.sql import functions as F

from stayscope.operators import models
from stayscope.operators.quality import unit_rules
from stayscope.sources import catalogs, sinks, tables
from stayscope.streaming.rows import silver_stream
from stayscope.suite.registry import layers_of

ITEMS = {
    "respiratory": {"chartevents": [{"itemid": 1, "label": "SpO2", "category": "x", "unit": "%", "table": "chartevents", "measurement_count": 5, "patient_count": 2, "stay_count": 2, "min_value": 1.0, "max_value": 2.0, "median_value": 1.5, "search_term_matched": "SpO2", "system": "respiratory"}]},
    "renal": {"labevents": [{"itemid": 2, "label": "Creatinine", "category": "y", "fluid": "Blood", "unit": "None", "measurement_count": 7}], "outputevents": []},
}


def folder():
    return tempfile.mkdtemp(prefix="run-test-")


def test_item_catalog_round_trip(spark):
    path = folder()
    with open(f"{path}/c.json", "w") as f:
        json.dump(ITEMS, f, indent=2)
    flat = catalogs.load_item_catalog(spark, f"{path}/c.json")
    got = {r["itemid"]: r for r in flat.collect()}
    assert sorted(got) == [1, 2] and got[2]["unit"] is None and got[2]["fluid"] == "Blood" and got[1]["source_table"] == "chartevents"
    catalogs.write_catalog_json(flat, f"{path}/out")
    again = catalogs.load_item_catalog(spark, f"{path}/out")
    assert sorted(r["itemid"] for r in again.collect()) == [1, 2]


def test_concept_map_is_keyed_by_item(spark):
    path = folder()
    concept = {"concept_name": "SpO2", "source_itemid": 1, "min_value": 70, "max_value": 100.0, "standard_unit": "%"}
    with open(f"{path}/m.json", "w") as f:
        json.dump({"3000000": dict(concept, concept_id=3000000), "3000001": dict(concept, concept_id=3000001)}, f)
    rows = catalogs.load_concept_map(spark, f"{path}/m.json").collect()
    assert [(r["itemid"], r["concept_id"], r["min_value"]) for r in rows] == [(1, 3000001, 70.0)]


def test_policy_slice_replaces_only_its_own_rows(spark):
    path = folder() + "/t"
    sinks.write_policy_slice(spark.createDataFrame([(1, "a"), (2, "b")], "v int, config_name string"), path)
    sinks.write_policy_slice(spark.createDataFrame([(3, "a")], "v int, config_name string"), path)
    assert sorted((r["v"], r["config_name"]) for r in spark.read.parquet(path).collect()) == [(2, "b"), (3, "a")]


def test_append_and_layer_table(spark):
    path = folder() + "/t"
    df = spark.createDataFrame([(1,)], "v int")
    sinks.append_rows(df, path)
    sinks.append_rows(df, path)
    assert spark.read.parquet(path).count() == 2
    sinks.write_layer(df, "layer_t")
    sinks.write_layer(df, "layer_t")
    assert spark.table("layer_t").count() == 1


def test_csv_round_trip(spark):
    path = folder() + "/csv"
    df = spark.sql("SELECT 1 AS a, timestamp_ntz'2024-01-01 01:02:03' AS t, map('k', 2) AS m")
    sinks.write_csv(df, path)
    row = tables.read_csv_typed(spark, path, "a int, t timestamp_ntz, m string").first()
    assert row["a"] == 1 and str(row["t"]) == "2024-01-01 01:02:03" and row["m"] == '{"k":2}'


def test_nan_arrives_as_null(spark):
    path = folder() + "/p"
    spark.createDataFrame([(float("nan"),), (1.0,)], "v double").write.parquet(path)
    assert tables.read_table(spark, path, "v double").filter("v IS NULL").count() == 1


def test_model_round_trip(spark):
    path = folder()
    df = spark.createDataFrame([(float(i), i % 2) for i in range(20)], "a double, y int")
    model = models.fit_lr(df, ["a"], "y", max_iter=5)
    sinks.save_model(model, path, models.model_metadata(model, "lr", ["a"], {"roc_auc": 0.5}))
    loaded, meta = sinks.load_model(path)
    assert meta["features"] == ["a"] and loaded.transform(df).count() == 20


def test_silver_rows_run_on_a_stream(spark):
    layers = layers_of(spark, "/root/testdata/sf0.001")
    path = folder() + "/bronze"
    layers.bronze_unflagged.write.parquet(path)
    stream = spark.readStream.schema(layers.bronze_unflagged.schema).parquet(path)
    out = silver_stream(stream, layers.views.concept_map, unit_rules(spark)).drop("storetime")
    query = out.withColumn("quality_flags", F.to_json("quality_flags")).writeStream.format("memory").queryName("silver_out").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("silver_out").count() == layers.silver.count()


def test_features_on_a_stream_are_written_once(spark):
    from stayscope.sources import versions
    from stayscope.streaming.rows import feature_stream, write_once
    from stayscope.suite.feature_queries import labelled

    rows = labelled(layers_of(spark, "/root/testdata/sf0.001"))
    path = folder()
    rows.repartition(3).write.parquet(f"{path}/in")

    def run(checkpoint):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        write_once(feature_stream(stream), f"{path}/out", f"{path}/{checkpoint}").awaitTermination()
        return versions.read_batches(spark, f"{path}/out")

    once = run("a").count()
    assert once == rows.count() and versions.latest(spark, f"{path}/out") == 3
    assert run("b").count() == once  # the checkpoint is lost and every batch comes again
    assert run("a").count() == once  # nothing new
    # a batch that was written and not published is run again and counts once
    rows.limit(5).write.parquet(versions.stage(f"{path}/out"))
    assert not versions.add_batch(rows.limit(5), f"{path}/out", 1) and versions.add_batch(rows.limit(5), f"{path}/out", 3)
    assert versions.read_batches(spark, f"{path}/out").count() == once + 5
