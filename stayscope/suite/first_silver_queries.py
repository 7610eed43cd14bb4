"""First-generation silver: enrichment, conversion, flags, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayscope.functions.columns import round_to, small_table
from stayscope.operators import dedup, extract, ordered, quality, reports
from stayscope.suite.layer_queries import ITEMS_BASIC
from stayscope.suite.registry import query
from stayscope.suite.sql_views import VIEWS

ALL_ITEMS = [*ITEMS_BASIC, 220339, 220045, 50821, 223835]
LIST = ", ".join(map(str, ALL_ITEMS))
# Conversions of this generation, exact case; NULL scale stands for one that fails
RULES = [("cmH2O", "mmHg", 1.0 / 1.36, 0.0), ("%", "fraction", None, 0.0)]
# Standard units that differ from the catalog's
STANDARD = {223835: "fraction", 50821: "kPa"}
FALLBACK = [("Heart Rate", 40.0, 180.0), ("Platelet Count", 20.0, 900.0)]

VIEWS["cv_g1"] = f"""
    SELECT row_id AS bronze_id, subject_id, hadm_id, stay_id, charttime, storetime, itemid, value, valuenum, valueuom,
           'chartevents' AS source_table FROM cv_chart
    WHERE itemid IN ({LIST}) AND valuenum IS NOT NULL AND (warning IS NULL OR warning = 0)
    UNION ALL
    SELECT row_id, subject_id, hadm_id, NULL, charttime, storetime, itemid, value, valuenum, valueuom, 'labevents'
    FROM cv_lab WHERE itemid IN ({LIST}) AND valuenum IS NOT NULL AND (flag IS NULL OR flag NOT IN ('abnormal', 'error'))"""
VIEWS["cv_g1map"] = """
    SELECT itemid, concept_id, concept_name, sofa_system,
           CASE itemid WHEN 223835 THEN 'fraction' WHEN 50821 THEN 'kPa' ELSE standard_unit END AS standard_unit,
           CASE WHEN itemid IN (220045, 51265) THEN NULL ELSE min_value END AS min_value,
           CASE WHEN itemid IN (220045, 51265) THEN NULL ELSE max_value END AS max_value
    FROM cv_cmap WHERE itemid <> 220210"""
VIEWS["cv_g1conv"] = """
    SELECT b.*, m.concept_id, m.concept_name, m.sofa_system, m.standard_unit, m.min_value, m.max_value,
           b.valueuom AS original_unit, b.valuenum AS original_value,
           b.valueuom = 'cmH2O' AND m.standard_unit = 'mmHg' AS converted,
           b.valueuom = '%' AND m.standard_unit = 'fraction' AS failed,
           lower(trim(b.valueuom)) = lower(m.standard_unit) AS same
    FROM cv_g1 b JOIN cv_g1map m USING (itemid)"""
VIEWS["cv_g1std"] = """
    SELECT * REPLACE (
             CASE WHEN converted THEN valuenum * (CAST(1.0 AS DOUBLE) / 1.36) ELSE valuenum END AS valuenum,
             CASE WHEN same OR converted THEN standard_unit ELSE valueuom END AS valueuom),
           CASE WHEN converted THEN 'Unit converted: cmH2O→mmHg' WHEN failed THEN 'Unit conversion failed: %→fraction'
                WHEN NOT same THEN 'Unknown unit conversion: ' || trim(valueuom) ELSE '' END AS note
    FROM cv_g1conv"""
VIEWS["cv_g1out"] = """
    SELECT *, coalesce(valuenum < lo OR valuenum > hi, FALSE) AS is_outlier FROM (
      SELECT *, CASE WHEN min_value IS NOT NULL THEN min_value WHEN concept_name = 'Heart Rate' THEN 40 WHEN concept_name = 'Platelet Count' THEN 20 END AS lo,
             CASE WHEN max_value IS NOT NULL THEN max_value WHEN concept_name = 'Heart Rate' THEN 180 WHEN concept_name = 'Platelet Count' THEN 900 END AS hi
      FROM cv_g1std)"""
VIEWS["cv_g1final"] = """
    SELECT * FROM cv_g1out QUALIFY row_number() OVER (PARTITION BY subject_id, itemid, charttime
        ORDER BY storetime IS NULL DESC, storetime DESC, bronze_id DESC) = 1"""


def rows(x):
    chart = extract.extract_chart_basic(x.views.chartevents, ALL_ITEMS)
    lab = extract.extract_lab_basic(x.views.labevents, ALL_ITEMS)
    return chart.unionByName(lab).withColumnRenamed("row_id", "bronze_id")


def concepts(x):
    own = ~F.col("itemid").isin(220045, 51265)
    return (
        x.views.concept_map.filter("itemid <> 220210")
        .withColumn("standard_unit", F.when(F.col("itemid") == 223835, "fraction").when(F.col("itemid") == 50821, "kPa").otherwise(F.col("standard_unit")))
        .withColumns({"min_value": F.when(own, F.col("min_value")), "max_value": F.when(own, F.col("max_value"))})
    )


def converted(x):
    mapped, _ = quality.enrich_with_concepts(rows(x), concepts(x))
    mapped = mapped.join(concepts(x).select("itemid", "sofa_system"), "itemid")
    rules = small_table(x.spark, RULES, "from_unit string, to_unit string, scale double, offset double")
    return quality.convert_units_basic(mapped, rules)


def flagged(x):
    fallback = small_table(x.spark, FALLBACK, "concept_name string, min_value double, max_value double")
    return quality.flag_outliers_basic(converted(x), fallback)


def finished(x):
    return quality.prepare_silver_basic(quality.flag_errors(dedup.dedup_latest(flagged(x))))


@query(
    "f6_convert_units_basic",
    """SELECT bronze_id, itemid, rnd(valuenum, 6) AS valuenum, valueuom, converted, failed AS error_flag,
              note AS log_head FROM cv_g1std""",
)
def _(x):
    # the log's numbers are cut off: their last digit depends on the engine's rounding
    return converted(x).select(
        "bronze_id", "itemid", round_to("valuenum", 6).alias("valuenum"), "valueuom", "converted", "error_flag",
        F.regexp_replace("transformation_log", r" \(.*\)$", "").alias("log_head"),
    )


@query("a13_conversion_counts", "SELECT valueuom AS from_unit, standard_unit AS to_unit, count(*) AS conversions FROM cv_g1conv WHERE converted GROUP BY 1, 2")
def _(x):
    return quality.conversion_counts(converted(x))


@query("f10_flag_outliers_basic", "SELECT bronze_id, itemid, is_outlier FROM cv_g1out")
def _(x):
    return flagged(x).select("bronze_id", "itemid", "is_outlier")


@query("d2_dedup_latest", "SELECT bronze_id, subject_id, itemid, charttime, storetime FROM cv_g1final")
def _(x):
    return dedup.dedup_latest(flagged(x)).select("bronze_id", "subject_id", "itemid", "charttime", "storetime")


@query(
    "d2_duplicates_resolved",
    """SELECT (SELECT count(*) FROM cv_g1out) AS rows_before, (SELECT count(*) FROM cv_g1final) AS rows_after,
              (SELECT count(*) FROM cv_g1out) - (SELECT count(*) FROM cv_g1final) AS duplicates_resolved""",
)
def _(x):
    return dedup.count_resolved(flagged(x))


@query(
    "f11_p11_silver_basic",
    """SELECT bronze_id, subject_id, hadm_id, stay_id, charttime, storetime, itemid, concept_name, concept_id,
              sofa_system AS parameter_type, rnd(valuenum, 6) AS value, valueuom, source_table, is_outlier, failed AS error_flag
       FROM cv_g1final""",
)
def _(x):
    return finished(x).drop("transformation_log").withColumn("value", round_to("value", 6))


@query(
    "a12_silver_summary",
    """SELECT count(*) AS total_records, count(DISTINCT subject_id) AS unique_patients, count(DISTINCT stay_id) AS unique_stays,
              count(DISTINCT concept_id) AS unique_concepts, count(DISTINCT itemid) AS unique_items,
              CAST(sum(is_outlier::INT) AS BIGINT) AS outliers, CAST(sum(failed::INT) AS BIGINT) AS errors FROM cv_g1final""",
)
def _(x):
    return reports.silver_summary(finished(x))


@query(
    "f14_number_rows",
    "SELECT bronze_id, subject_id, charttime, row_number() OVER (ORDER BY subject_id, charttime, bronze_id) AS position FROM cv_g1",
)
def _(x):
    numbered = rows(x).select("bronze_id", "subject_id", "charttime")
    return ordered.global_positions(numbered, ["subject_id", "charttime", "bronze_id"])


@query(
    "f7_outliers_converted",
    """SELECT b.id AS bronze_id, coalesce(CASE WHEN lower(b.valueuom) = 'cmh2o' AND m.standard_unit = 'mmHg' THEN b.valuenum / 1.36 ELSE b.valuenum END > 5
              AND b.itemid = 220339, FALSE) AS outlier_detected
       FROM cv_bronze b LEFT JOIN cv_cmap m USING (itemid) WHERE NOT b.is_outlier AND NOT b.is_suspicious""",
)
def _(x):
    # limits are tightened for one item so that the flag can fire after the range filter
    tight = F.col("itemid") == 220339
    mapped = quality.apply_concepts(quality.silver_input(x.bronze), x.views.concept_map).withColumn(
        "max_value", F.when(tight, F.lit(5.0)).otherwise(F.col("max_value"))
    )
    done = quality.flag_outliers_std(quality.convert_units(mapped, x.rules), use="converted")
    return done.select("bronze_id", "outlier_detected")


@query(
    "f9_silver_flags",
    """SELECT bronze_id, CASE WHEN converted THEN '{"UNIT_CONVERTED":true}' ELSE '{}' END AS quality_flags, transformation_log
       FROM cv_silver""",
)
def _(x):
    return x.silver.select("bronze_id", F.to_json("quality_flags").alias("quality_flags"), "transformation_log")


@query(
    "f8_suspicious_flag",
    """SELECT id AS bronze_id, coalesce(valuenum > 150, FALSE) AS suspicious, coalesce(valuenum > 150, FALSE) AS logged FROM cv_bronze b JOIN cv_cmap m USING (itemid)""",
)
def _(x):
    # without the quality filter doubtful rows reach silver; a bound stands for the bronze flag
    doubtful = x.bronze.withColumn("is_suspicious", F.col("valuenum") > 150).withColumnRenamed("id", "bronze_id")
    mapped = quality.apply_concepts(doubtful, x.views.concept_map).filter("concept_id IS NOT NULL")
    done = quality.build_flags(quality.flag_outliers_std(quality.convert_units(mapped, x.rules)))
    return done.select(
        "bronze_id", quality.has_flag("SUSPICIOUS_VALUE").alias("suspicious"), F.col("transformation_log").contains("suspicious in Bronze").alias("logged")
    )
