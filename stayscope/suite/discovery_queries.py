"""Item discovery and the catalogs built from it."""

from __future__ import annotations

from stayscope.functions.columns import round_to
from stayscope.operators import discovery
from stayscope.suite.registry import query
from stayscope.suite.sql_views import VIEWS, expand_rnd, values


def _stats(view, dictionary, value, source, least, stay, fluid, unit, positive):
    more = f"AND m.{value} > 0" if positive else ""
    return f"""SELECT d.itemid, d.label, d.category, {fluid} AS fluid, {unit} AS unit, '{source}' AS source_table,
        count(*) AS measurement_count, count(DISTINCT subject_id) AS patient_count,
        {stay} AS stay_count, min(m.{value}) AS min_value, max(m.{value}) AS max_value,
        rnd(quantile_cont(m.{value}, 0.5), 6) AS median_value
        FROM {view} m JOIN cv_items d ON d.itemid = m.itemid AND {dictionary} WHERE m.{value} IS NOT NULL {more}
        GROUP BY d.itemid, d.label, d.category, d.fluid, d.unit HAVING count(*) >= {least}"""


ICU, LAB = "d.source_table <> 'labevents'", "d.source_table = 'labevents'"
STAY = "count(DISTINCT stay_id)"
NONE = "CAST(NULL AS VARCHAR)"
CHART_SQL = _stats("cv_chart", ICU, "valuenum", "chartevents", 10, STAY, NONE, "d.unit", False)
LAB_SQL = _stats("cv_lab", LAB, "valuenum", "labevents", 10, "CAST(NULL AS BIGINT)", "d.fluid", "min(m.valueuom)", False)
OUT_SQL = _stats("cv_out", ICU, "value", "outputevents", 10, STAY, NONE, "d.unit", True)
IN_SQL = _stats("cv_in", ICU, "amount", "inputevents", 5, STAY, NONE, "d.unit", True)


def _shown(df):
    return df.withColumn("median_value", round_to("median_value", 6))


@query("a1_discover_chart", CHART_SQL)
def _(x):
    return _shown(discovery.discover_items(x.views.chartevents, x.views.d_items, "chartevents"))


@query("a2_discover_lab", LAB_SQL)
def _(x):
    return _shown(discovery.discover_items(x.views.labevents, x.views.d_labitems, "labevents", unit="valueuom"))


@query("a3_discover_output", OUT_SQL)
def _(x):
    return _shown(discovery.discover_items(x.views.outputevents, x.views.d_items, "outputevents", value="value", positive=True))


@query("a4_discover_input", IN_SQL)
def _(x):
    return _shown(discovery.discover_items(x.views.inputevents, x.views.d_items, "inputevents", value="amount", positive=True))


def _terms(terms, allowed):
    rows = [(s, i, src, p, w) for i, (s, ws) in enumerate(terms.items()) for src in allowed(s) for p, w in enumerate(ws)]
    return values(rows, "sofa_system, system_pos, source_table, pos, term")


VIEWS["cv_terms"] = _terms(
    discovery.TERMS,
    lambda s: {
        "respiratory": ["chartevents", "labevents"], "cardiovascular": ["chartevents", "inputevents"],
        "coagulation": ["labevents"], "liver": ["labevents"], "cns": ["chartevents"],
        "renal": ["chartevents", "labevents", "outputevents"],
    }[s],
)
VIEWS["cv_terms2"] = _terms(discovery.TERMS_REBUILD, lambda s: ["chartevents", "labevents", "outputevents"])
VIEWS["cv_found"] = expand_rnd(f"SELECT * FROM ({CHART_SQL}) UNION ALL ({LAB_SQL}) UNION ALL ({OUT_SQL}) UNION ALL ({IN_SQL})")
VIEWS["cv_matched"] = """
    SELECT f.*, t.sofa_system, t.system_pos, t.term AS search_term_matched FROM cv_found f
    JOIN cv_terms t ON t.source_table = f.source_table AND contains(upper(f.label), upper(t.term))
    QUALIFY row_number() OVER (PARTITION BY f.source_table, f.itemid, t.sofa_system ORDER BY t.pos) = 1"""
LIMIT_UNIT = """CASE WHEN upper(label) LIKE '%PAO2%' OR upper(label) LIKE '%PO2%' THEN 'mmHg'
    WHEN upper(label) LIKE '%OXYGEN SAT%' THEN '%' WHEN upper(label) LIKE '%FIO2%' THEN 'fraction'
    WHEN upper(label) LIKE '%MAP%' OR upper(label) LIKE '%MEAN ARTERIAL%' OR upper(label) LIKE '%SYSTOLIC%' OR upper(label) LIKE '%DIASTOLIC%' THEN 'mmHg'
    WHEN upper(label) LIKE '%EPINEPHRINE%' OR upper(label) LIKE '%DOPAMINE%' THEN 'mcg/kg/min'
    WHEN upper(label) LIKE '%PLATELET%' THEN 'K/uL' WHEN upper(label) LIKE '%BILIRUBIN%' THEN 'mg/dL'
    WHEN upper(label) LIKE '%GCS%' THEN 'points' WHEN upper(label) LIKE '%CREATININE%' THEN 'mg/dL' ELSE coalesce(unit, '') END"""


def _limit(which, pairs):
    body = " ".join(f"WHEN upper(label) LIKE '%{p}%' THEN {v}::DOUBLE" for p, v in pairs)
    return f"CASE {body} ELSE {which} END"


LOW = _limit("min_value", [("PO2", 40), ("PAO2", 40), ("FIO2", 0.21), ("MAP", 40), ("MEAN ARTERIAL", 40), ("SYSTOLIC", 70), ("DIASTOLIC", 30), ("EPINEPHRINE", 0), ("DOPAMINE", 0), ("PLATELET", 10), ("BILIRUBIN", 0.1), ("GCS", 3), ("CREATININE", 0.3)])
HIGH = _limit("max_value", [("PO2", 500), ("PAO2", 500), ("FIO2", 1.0), ("MAP", 150), ("MEAN ARTERIAL", 150), ("SYSTOLIC", 250), ("DIASTOLIC", 150), ("EPINEPHRINE", 100), ("DOPAMINE", 100), ("PLATELET", 1000), ("BILIRUBIN", 30), ("GCS", 15), ("CREATININE", 15)])


def _all(x):
    v = x.views
    return discovery.discover_all(v.chartevents, v.labevents, v.outputevents, v.inputevents, v.d_items, v.d_labitems)


@query("a5_match_terms", "SELECT source_table, itemid, label, sofa_system, search_term_matched, measurement_count FROM cv_matched")
def _(x):
    matched = discovery.match_terms(_all(x), discovery.search_terms(x.spark))
    return matched.select("source_table", "itemid", "label", "sofa_system", "search_term_matched", "measurement_count")


@query(
    "f3_infer_limits",
    f"SELECT itemid, label, sofa_system, {LIMIT_UNIT} AS standard_unit, {LOW} AS limit_low, {HIGH} AS limit_high FROM cv_matched",
)
def _(x):
    matched = discovery.match_terms(_all(x), discovery.search_terms(x.spark))
    return discovery.infer_limits(matched).select("itemid", "label", "sofa_system", "standard_unit", "limit_low", "limit_high")


@query(
    "f13_assign_concepts",
    """SELECT itemid, sofa_system, source_table, CAST(2999999 + row_number() OVER (ORDER BY system_pos,
              list_position(['chartevents', 'labevents', 'outputevents', 'inputevents'], source_table),
              measurement_count DESC, itemid) AS INTEGER) AS concept_id FROM cv_matched""",
)
def _(x):
    matched = discovery.match_terms(_all(x), discovery.search_terms(x.spark))
    return discovery.assign_concepts(matched).select("itemid", "sofa_system", "source_table", "concept_id")


COUNTS = " UNION ALL ".join(
    f"SELECT m.itemid, d.label, '{s}' AS source_table, count(*) AS measurement_count FROM {v} m JOIN cv_items d ON d.itemid = m.itemid GROUP BY 1, 2"
    for v, s in (("cv_chart", "chartevents"), ("cv_lab", "labevents"), ("cv_out", "outputevents"))
)
VIEWS["cv_matched2"] = f"""
    SELECT c.itemid, c.label, c.source_table, c.measurement_count, t.sofa_system, t.term AS search_term_matched, t.system_pos
    FROM ({COUNTS}) c JOIN cv_terms2 t ON t.source_table = c.source_table AND contains(upper(c.label), upper(t.term))"""


def _rebuild(x):
    v = x.views
    counts = (
        discovery.count_items(v.chartevents, v.d_items, "chartevents")
        .unionByName(discovery.count_items(v.labevents, v.d_labitems, "labevents"))
        .unionByName(discovery.count_items(v.outputevents, v.d_items, "outputevents"))
    )
    return discovery.match_terms(counts, discovery.search_terms(x.spark, "rebuild"), first_only=False)


@query("a6_discover_rebuild", "SELECT * EXCLUDE (system_pos) FROM cv_matched2")
def _(x):
    return _rebuild(x).select("itemid", "label", "source_table", "measurement_count", "sofa_system", "search_term_matched")


@query(
    "f4_infer_limits_rebuild",
    """SELECT itemid, label, search_term_matched,
              CASE WHEN label = 'SpO2' THEN '%' WHEN label = 'Platelet Count' THEN 'K/uL'
                   WHEN label IN ('Creatinine', 'Bilirubin, Total') THEN 'mg/dL' WHEN label LIKE 'GCS%' THEN 'score'
                   WHEN label LIKE '%Pressure%' THEN 'mmHg' ELSE 'unit' END AS standard_unit,
              CASE WHEN label = 'SpO2' THEN 70 WHEN label = 'Platelet Count' THEN 10 WHEN label = 'Creatinine' THEN 0.3
                   WHEN label = 'Bilirubin, Total' THEN 0.1 WHEN label LIKE 'GCS%' THEN 3
                   WHEN label LIKE '%Pressure%' THEN 20 ELSE 0 END::DOUBLE AS limit_low,
              CASE WHEN label = 'SpO2' THEN 100 WHEN label = 'Platelet Count' THEN 1000 WHEN label = 'Creatinine' THEN 15
                   WHEN label = 'Bilirubin, Total' THEN 50 WHEN label LIKE 'GCS%' THEN 15
                   WHEN label LIKE '%Pressure%' THEN 200 ELSE 1000000 END::DOUBLE AS limit_high
       FROM cv_matched2""",
)
def _(x):
    return discovery.infer_limits(_rebuild(x), "rebuild").select(
        "itemid", "label", "search_term_matched", "standard_unit", "limit_low", "limit_high"
    )
