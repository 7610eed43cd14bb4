"""Sinks and readers: what was written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stayscope.functions.columns import round_to
from stayscope.operators import discovery, validate
from stayscope.session import shared_folder
from stayscope.sources import catalogs, sinks, tables, versions
from stayscope.suite.policy_queries import simple
from stayscope.suite.registry import query
from stayscope.suite.windowed_queries import events


def _path(x, name: str) -> str:
    return f"{shared_folder(x.spark)}/{x.spark.sparkContext.applicationId}/io-{name}-{uuid.uuid4().hex}"


@query("io1_read_table", "SELECT event_type, count(*) AS n, count(value) AS known FROM events GROUP BY 1")
def _(x):
    df = tables.read_table(x.spark, f"{x.views.folder}/events.parquet")
    return df.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("known"))


@query(
    "io2_io10_csv_round_trip",
    "SELECT subject_id, stay_id, charttime, concept_name, rnd(value, 6) AS value FROM cv_ev",
)
def _(x):
    path = _path(x, "csv")
    rows = events(x).select("subject_id", "stay_id", "charttime", "concept_name", "value")
    sinks.write_csv(rows, path)
    back = tables.read_csv_typed(x.spark, path, "subject_id bigint, stay_id bigint, charttime timestamp_ntz, concept_name string, value double")
    return back.withColumn("value", round_to("value", 6))


@query(
    "io3_io11_catalog_round_trip",
    "SELECT itemid, label, sofa_system, source_table, measurement_count, search_term_matched FROM cv_matched",
)
def _(x):
    v = x.views
    items = discovery.discover_all(v.chartevents, v.labevents, v.outputevents, v.inputevents, v.d_items, v.d_labitems)
    path = _path(x, "catalog")
    catalogs.write_catalog_json(discovery.match_terms(items, discovery.search_terms(x.spark)), path)
    back = catalogs.load_item_catalog(x.spark, path)
    return back.select("itemid", "label", "sofa_system", "source_table", "measurement_count", "search_term_matched")


@query(
    "io8_policy_slice",
    "SELECT config_name, count(*) AS n, CAST(sum(sofa_score) AS BIGINT) AS total FROM cv_both GROUP BY 1",
)
def _(x):
    path = _path(x, "slice")
    sinks.write_policy_slice(simple(x, 1), path)
    sinks.write_policy_slice(simple(x, 2), path)
    sinks.write_policy_slice(simple(x, 1), path)  # replaces its own rows only
    return x.spark.read.parquet(path).groupBy("config_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sofa_score").cast("bigint").alias("total")
    )


@query("io9_append_rows", "SELECT 2 * count(*) AS n FROM cv_simple1")
def _(x):
    path = _path(x, "append")
    sinks.append_rows(simple(x, 1), path)
    sinks.append_rows(simple(x, 1), path)
    return x.spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


@query("io5_layer_table", "SELECT subject_id, stay_id, concept_id, count(*) AS n, count(value) AS known FROM cv_ev GROUP BY 1, 2, 3")
def _(x):
    table = f"layer_{uuid.uuid4().hex}"
    sinks.write_layer(events(x).withColumn("part", F.col("concept_id") % 8), table, partition_by="part")
    return x.spark.table(table).groupBy("subject_id", "stay_id", "concept_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("known"))


@query(
    "io4_concept_map",
    """SELECT itemid, max(arg_max) AS concept_name FROM (SELECT itemid, arg_max(label, itemid) AS arg_max FROM cv_matched GROUP BY 1) GROUP BY 1""",
)
def _(x):
    v = x.views
    items = discovery.match_terms(discovery.discover_all(v.chartevents, v.labevents, v.outputevents, v.inputevents, v.d_items, v.d_labitems), discovery.search_terms(x.spark))
    each = items.groupBy("itemid").agg(F.max_by("label", "itemid").alias("label"))
    concept = F.struct(F.col("itemid").cast("string").alias("source_itemid"), F.col("itemid").cast("int").alias("concept_id"), F.col("label").alias("concept_name"))
    path = _path(x, "concepts")
    each.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("itemid").cast("string"), concept)))).alias("value")).write.text(path)
    return catalogs.load_concept_map(x.spark, path).select("itemid", "concept_name")


@query("v12_schema", "SELECT column_name, TRUE AS present, (SELECT count(*) FROM cv_silver) AS rows FROM (VALUES ('subject_id'), ('stay_id'), ('charttime'), ('concept_id')) t(column_name)")
def _(x):
    found = validate.v_schema(x.silver, ["subject_id", "stay_id", "charttime", "concept_id"])
    return found.select("column_name", "present", x.silver.agg(F.count(F.lit(1))).scalar().alias("rows"))


@query(
    "io6_replace_layer",
    """SELECT subject_id, stay_id, concept_id, count(*) AS n, count(value) AS known, count(*) FILTER (value > 100) AS high,
              (SELECT count(*) FROM cv_ev) AS rows_before FROM cv_ev WHERE concept_id % 2 = 0 GROUP BY 1, 2, 3""",
)
def _(x):
    path = _path(x, "replaced")
    versions.replace_table(events(x), path)
    before = versions.read_published(x.spark, path)
    # the new rows come from the table that they replace
    versions.replace_table(before.filter("concept_id % 2 = 0"), path)
    # a writer that stops before publishing changes nothing
    before.limit(0).write.parquet(versions.stage(path))
    now = versions.read_published(x.spark, path)
    out = now.groupBy("subject_id", "stay_id", "concept_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("known"), F.count(F.when(F.col("value") > 100, 1)).alias("high")
    )
    return out.withColumn("rows_before", before.agg(F.count(F.lit(1))).scalar())
