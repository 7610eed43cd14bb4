"""Extraction, deduplication, flags and the layer tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stayscope.operators import dedup, extract, quality
from stayscope.functions.columns import round_to
from stayscope.suite.registry import query

BRONZE_SHOWN = [
    "subject_id", "hadm_id", "stay_id", "itemid", "charttime", "value", "valuenum", "valueuom", "label", "category",
    "source_table", "source_fluid", "is_sofa_parameter", "sofa_system", "search_term_matched",
]
BRONZE_SQL = ", ".join(BRONZE_SHOWN)
ITEMS_BASIC = [220052, 220277, 220210, 50912, 51265]


@query("p4_bronze_chart", f"SELECT row_id, {BRONZE_SQL} FROM cv_bchart")
def _(x):
    return x.bronze_chart


@query("p5_bronze_lab", f"SELECT row_id, {BRONZE_SQL} FROM cv_blab")
def _(x):
    return x.bronze_lab


@query("p6_bronze_output", f"SELECT row_id, {BRONZE_SQL} FROM cv_bout")
def _(x):
    return x.bronze_output


@query("p7_bronze_input", f"SELECT row_id, {BRONZE_SQL} FROM cv_bin")
def _(x):
    return x.bronze_input


@query("d1_dedup_unique_key", f"SELECT row_id AS id, {BRONZE_SQL} FROM cv_bunique")
def _(x):
    return x.bronze_unflagged


@query("f1_f2_bronze_flags", f"SELECT id, {BRONZE_SQL}, is_outlier, is_suspicious FROM cv_bronze")
def _(x):
    return x.bronze_plan.select("id", *BRONZE_SHOWN, "is_outlier", "is_suspicious")


@query(
    "f5_p10_silver",
    """SELECT bronze_id, subject_id, hadm_id, stay_id, charttime, itemid, label, category, concept_id, concept_name,
              'Measurement' AS concept_domain, 'MIMIC-IV' AS vocabulary_id, sofa_system, sofa_parameter_type,
              value_original, valuenum_original, valueuom_original, rnd(valuenum_std, 6) AS valuenum_std, unit_std,
              source_table, source_fluid,
              CASE WHEN converted THEN '{"UNIT_CONVERTED":true}' ELSE '{}' END AS quality_flags, transformation_log
       FROM cv_silver""",
)
def _(x):
    return (
        x.silver_plan.drop("storetime")
        .withColumn("valuenum_std", round_to("valuenum_std", 6))
        .withColumn("quality_flags", F.to_json("quality_flags"))
    )


@query("p1_find_items", "SELECT itemid, label, category FROM cv_ditems WHERE lower(label) LIKE '%rate%' OR lower(label) LIKE '%o2%' OR lower(label) LIKE '%pressure%'")
def _(x):
    # the dictionary view is itself derived from the items that occur in the measurements
    seen = x.views.measurements.select("itemid").distinct()
    present = x.views.d_items.join(seen, "itemid", "left_semi")
    return extract.find_items(present, ["rate", "O2", "Pressure"]).select("itemid", "label", "category")


LIST = ", ".join(map(str, ITEMS_BASIC))


@query(
    "p2_extract_chart_basic",
    f"""SELECT row_id, subject_id, hadm_id, stay_id, charttime, storetime, itemid, value, valuenum, valueuom,
               'chartevents' AS source_table FROM cv_chart
        WHERE itemid IN ({LIST}) AND valuenum IS NOT NULL AND (warning IS NULL OR warning = 0)""",
)
def _(x):
    return extract.extract_chart_basic(x.views.chartevents, ITEMS_BASIC)


@query(
    "p3_extract_lab_basic",
    f"""SELECT row_id, subject_id, hadm_id, CAST(NULL AS BIGINT) AS stay_id, charttime, storetime, itemid, value, valuenum, valueuom,
               'labevents' AS source_table FROM cv_lab
        WHERE itemid IN ({LIST}) AND valuenum IS NOT NULL AND (flag IS NULL OR flag NOT IN ('abnormal', 'error'))""",
)
def _(x):
    return extract.extract_lab_basic(x.views.labevents, ITEMS_BASIC)


@query(
    "p8_item_systems",
    "SELECT DISTINCT itemid, source_table, sofa_system, search_term_matched FROM cv_ball",
)
def _(x):
    return x.bronze.select("itemid", "source_table", "sofa_system", "search_term_matched").distinct()


@query(
    "p9_silver_input",
    "SELECT id AS bronze_id, subject_id, stay_id, itemid, charttime, valuenum FROM cv_bronze WHERE NOT is_outlier AND NOT is_suspicious",
)
def _(x):
    return quality.silver_input(x.bronze).select("bronze_id", "subject_id", "stay_id", "itemid", "charttime", "valuenum")


@query(
    "p13_eligible_stays",
    "SELECT subject_id, hadm_id, stay_id, intime, outtime, 240.0::DOUBLE AS duration_hours FROM cv_stays WHERE 240 BETWEEN 24 AND 720",
)
def _(x):
    return extract.eligible_stays(x.views.stays, min_hours=24, max_days=30)


COHORT = "SELECT DISTINCT subject_id, hadm_id FROM cv_dx WHERE replace(icd_code, '.', '') IN ('J9601', 'J80')"


@query("p14_diagnosis_cohort", COHORT)
def _(x):
    return extract.diagnosis_cohort(x.views.diagnoses, ["J96.01", "J80"])


@query(
    "p15_label_cohort",
    f"""SELECT s.*, CASE WHEN subject_id IN (SELECT subject_id FROM ({COHORT})) THEN 'ARI' ELSE 'OTHER' END AS disease_type
        FROM cv_stays s""",
)
def _(x):
    return extract.label_cohort(x.views.stays, extract.diagnosis_cohort(x.views.diagnoses, ["J96.01", "J80"]))


@query(
    "p16_sample_items",
    """SELECT id, subject_id, stay_id, charttime, itemid, valuenum, valueuom FROM cv_bronze
       WHERE itemid IN (220210, 224688, 224689, 224690) AND valuenum IS NOT NULL
       ORDER BY subject_id, charttime, itemid, id LIMIT 20""",
)
def _(x):
    return extract.sample_items(x.bronze, [220210, 224688, 224689, 224690])


REBUILD = ", ".join(c for c in BRONZE_SHOWN)


@query(
    "p18_bronze_rebuild",
    f"""SELECT row_id, {REBUILD} FROM cv_bchart WHERE valuenum IS NOT NULL UNION ALL SELECT row_id, {REBUILD} FROM cv_blab WHERE valuenum IS NOT NULL
        UNION ALL SELECT row_id, {REBUILD} FROM cv_bout""",
)
def _(x):
    v = x.views
    return extract.bronze_rebuild(v.chartevents, v.labevents, v.outputevents, v.d_items, v.d_labitems, v.stays, v.catalog)


@query(
    "f12_silver_rebuild",
    f"""SELECT b.subject_id, b.hadm_id, b.stay_id, m.concept_id, m.concept_name, b.charttime, b.valuenum AS value, b.valueuom,
               m.standard_unit, FALSE AS is_outlier, b.sofa_system, b.itemid AS original_itemid, b.source_table, m.conversion_factor
        FROM (SELECT {REBUILD} FROM cv_bchart WHERE valuenum IS NOT NULL UNION ALL SELECT {REBUILD} FROM cv_blab
              UNION ALL SELECT {REBUILD} FROM cv_bout) b
        JOIN cv_cmap m ON m.itemid = b.itemid WHERE b.valuenum BETWEEN m.min_value AND m.max_value""",
)
def _(x):
    v = x.views
    bronze = extract.bronze_rebuild(v.chartevents, v.labevents, v.outputevents, v.d_items, v.d_labitems, v.stays, v.catalog)
    return quality.silver_rebuild(bronze, v.concept_map)


@query(
    "j2_interval_join",
    """SELECT m.row_id, m.subject_id, s.stay_id, m.charttime FROM cv_lab m
       JOIN cv_stays s ON s.subject_id = m.subject_id AND m.charttime BETWEEN s.intime AND s.outtime""",
)
def _(x):
    from stayscope.operators.ordered import interval_join

    labs = x.views.labevents.select("row_id", "subject_id", "charttime")
    spans = x.views.stays.select("subject_id", "stay_id", "intime", "outtime")
    return interval_join(labs, spans, "subject_id", "charttime", "intime", "outtime").select(
        "row_id", "subject_id", "stay_id", "charttime"
    )


# The concept map without two items, so that unmapped rows occur
PARTIAL = "itemid NOT IN (220045, 50821)"


@query(
    "j3_apply_concepts",
    f"""SELECT b.id, b.itemid, m.concept_id, m.concept_name, m.standard_unit FROM cv_bronze b
        LEFT JOIN (SELECT * FROM cv_cmap WHERE {PARTIAL}) m USING (itemid)""",
)
def _(x):
    return quality.apply_concepts(x.bronze, x.views.concept_map.filter(PARTIAL)).select(
        "id", "itemid", "concept_id", "concept_name", "standard_unit"
    )


@query(
    "j4_enrich_mapped",
    f"SELECT b.id, b.itemid, m.concept_id, m.concept_name FROM cv_bronze b JOIN cv_cmap m USING (itemid) WHERE m.{PARTIAL}",
)
def _(x):
    mapped, _unmapped = quality.enrich_with_concepts(x.bronze, x.views.concept_map.filter(PARTIAL))
    return mapped.select("id", "itemid", "concept_id", "concept_name")


@query("j4_unmapped_items", f"SELECT DISTINCT itemid FROM cv_bronze WHERE NOT ({PARTIAL})")
def _(x):
    _mapped, unmapped = quality.enrich_with_concepts(x.bronze, x.views.concept_map.filter(PARTIAL))
    return unmapped


@query(
    "j9_l2_top_items",
    """SELECT b.itemid, coalesce(d.label, l.label) AS label, b.source_table, count(*) AS measurements,
              count(DISTINCT b.subject_id) AS patients
       FROM cv_bronze b LEFT JOIN cv_ditems d ON d.itemid = b.itemid AND b.source_table <> 'labevents'
       LEFT JOIN cv_dlabitems l ON l.itemid = b.itemid AND b.source_table = 'labevents'
       GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 3 LIMIT 20""",
)
def _(x):
    return extract.top_items(extract.label_items(x.bronze, x.views.d_items, x.views.d_labitems))


# Labels expected per source
EXPECTED = [
    *[("chartevents", t) for t in ("spo2", "respiratory rate", "heart rate", "tidal volume", "minute ventilation")],
    *[("labevents", t) for t in ("ph", "paco2", "creatinine", "albumin", "d-dimer", "procalcitonin")],
]


@query(
    "j13_term_coverage",
    f"""SELECT t.source_table, t.term, coalesce(bool_or(contains(l.label, t.term)), FALSE) AS found,
               count(CASE WHEN contains(l.label, t.term) THEN 1 END) AS matching_labels
        FROM (VALUES {', '.join(str(e) for e in EXPECTED)}) t(source_table, term)
        LEFT JOIN (SELECT DISTINCT source_table, lower(label) AS label FROM cv_bronze) l USING (source_table)
        GROUP BY 1, 2""",
)
def _(x):
    from stayscope.functions.columns import small_table

    return extract.term_coverage(x.bronze, small_table(x.spark, EXPECTED, "source_table string, term string"))


@query("d3_union_sources", "SELECT source_table, count(*) AS n FROM cv_ball GROUP BY 1")
def _(x):
    from stayscope.operators.reports import count_by

    parts = [x.bronze_chart, x.bronze_lab, x.bronze_output, x.bronze_input]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return count_by(rows, "source_table").withColumnRenamed("records", "n")


@query("d5_distinct_labels", "SELECT DISTINCT source_table, label, sofa_system FROM cv_bronze")
def _(x):
    return x.bronze.select("source_table", "label", "sofa_system").distinct()
