"""Shared views of the oracle SQL, mirroring the driver views and layers.

A query names the views it needs as ``cv_...``; ``with_views`` puts their
definitions, and those of the views they read, in front of it.
"""

from __future__ import annotations

import re

from stayscope.sources.driver_views import ITEMS, LIMITS


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    if isinstance(v, float):
        return f"CAST({v} AS DOUBLE)"
    return str(v)


def values(rows, columns: str) -> str:
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


NUMBER_TEXT = r"regexp_replace(CAST(CAST({0} AS DECIMAL(28,6)) AS VARCHAR), '\.?0+$', '')"
BLOCK = "CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END"
H24 = 86_400_000_000

VIEWS: dict[str, str] = {
    "cv_items": values(
        ITEMS, "event_type, slot, itemid, label, category, fluid, sofa_system, source_table, unit, base, scale, modulus, term"
    ),
    "cv_cmap": (
        "SELECT l.itemid, l.concept_id, i.label AS concept_name, i.sofa_system, i.source_table, l.standard_unit, "
        "l.min_value, l.max_value, CAST(1.0 AS DOUBLE) AS conversion_factor FROM ("
        + values(LIMITS, "itemid, concept_id, standard_unit, min_value, max_value")
        + ") l JOIN cv_items i USING (itemid)"
    ),
    "cv_ditems": "SELECT itemid, label, category FROM cv_items WHERE source_table <> 'labevents'",
    "cv_dlabitems": "SELECT itemid, label, category, fluid FROM cv_items WHERE source_table = 'labevents'",
    "cv_meas": f"""
        SELECT (e.event_id * 2 + e.rep) * 32 + c.slot AS row_id, e.event_id, e.user_id AS subject_id,
               e.user_id * 10 + {BLOCK} AS hadm_id, e.user_id * 10 + {BLOCK} AS stay_id, e.ts AS charttime,
               CASE WHEN e.rep = 1 AND e.event_id % 20 = 0 THEN NULL
                    WHEN e.rep = 1 THEN e.ts + INTERVAL 2 HOUR ELSE e.ts + INTERVAL 1 HOUR END AS storetime,
               c.itemid, c.label, c.category, c.fluid, c.sofa_system, c.source_table, c.unit,
               c.base + c.scale * e.value + (CAST(json_extract_string(e.props, '$.k') AS INT) % c.modulus) AS valuenum
        FROM (SELECT *, 0 AS rep FROM events UNION ALL SELECT *, 1 AS rep FROM events WHERE event_id % 10 = 0) e
        JOIN cv_items c ON e.event_type = c.event_type""",
    "cv_chart": f"""
        SELECT row_id, subject_id, hadm_id, CASE WHEN event_id % 50 <> 3 THEN stay_id END AS stay_id, charttime, storetime,
               itemid, CASE WHEN event_id % 40 = 7 THEN 'unable to obtain' ELSE {NUMBER_TEXT.format('valuenum')} END AS value,
               CASE WHEN event_id % 40 <> 7 THEN valuenum END AS valuenum, unit AS valueuom,
               CASE WHEN event_id % 25 = 0 THEN 1 WHEN event_id % 3 <> 0 THEN 0 END AS warning
        FROM cv_meas WHERE source_table = 'chartevents'""",
    "cv_lab": f"""
        SELECT row_id, subject_id, hadm_id,
               CASE WHEN event_id % 30 = 11 THEN charttime + INTERVAL 40 DAY ELSE charttime END AS charttime, storetime,
               itemid, {NUMBER_TEXT.format('valuenum')} AS value, valuenum, unit AS valueuom,
               CASE WHEN event_id % 12 = 0 THEN 'abnormal' WHEN event_id % 7 = 0 THEN 'delta' END AS flag
        FROM cv_meas WHERE source_table = 'labevents'""",
    "cv_out": """
        SELECT row_id, subject_id, hadm_id, stay_id, charttime, itemid,
               CASE WHEN event_id % 33 = 0 THEN CAST(0.0 AS DOUBLE) ELSE valuenum END AS value, unit AS valueuom
        FROM cv_meas WHERE source_table = 'outputevents'""",
    "cv_in": """
        SELECT row_id, subject_id, hadm_id, stay_id, charttime AS starttime, itemid, valuenum AS amount, unit AS amountuom
        FROM cv_meas WHERE source_table = 'inputevents'""",
    "cv_stays": f"""
        SELECT subject_id, subject_id * 10 + n AS hadm_id, subject_id * 10 + n AS stay_id,
               TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(10 * n AS INTEGER)) AS intime,
               TIMESTAMP '2024-01-11 00:00:00' + to_days(CAST(10 * n AS INTEGER)) AS outtime
        FROM (SELECT DISTINCT user_id AS subject_id, {BLOCK} AS n FROM events)""",
    "cv_adm": """
        SELECT subject_id, hadm_id, intime AS admittime, outtime AS dischtime,
               CASE WHEN subject_id % 7 = 0 THEN intime + to_days(CAST(subject_id % 9 + 1 AS INTEGER)) END AS deathtime,
               CASE WHEN subject_id % 7 = 0 THEN 1 ELSE 0 END AS hospital_expire_flag,
               CASE WHEN subject_id % 2 = 0 THEN 'EMERGENCY' ELSE 'ELECTIVE' END AS admission_type
        FROM cv_stays""",
    "cv_dx": """
        SELECT o_custkey AS subject_id, o_custkey * 10 + o_orderkey % 3 AS hadm_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'J96.01' WHEN '2-HIGH' THEN 'J80' ELSE 'I10' END AS icd_code,
               10 AS icd_version FROM orders""",
    "cv_pat": """
        SELECT c_custkey AS subject_id, CAST(c_custkey % 70 + 18 AS INTEGER) AS age,
               CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender FROM customer""",
    # layers
    "cv_bchart": """
        SELECT m.row_id, m.subject_id, m.hadm_id, m.stay_id, m.itemid, m.charttime, m.value, m.valuenum, m.valueuom,
               d.label, d.category, 'chartevents' AS source_table, CAST(NULL AS VARCHAR) AS source_fluid,
               TRUE AS is_sofa_parameter, c.sofa_system, c.term AS search_term_matched
        FROM cv_chart m JOIN cv_ditems d USING (itemid)
        JOIN cv_items c ON c.itemid = m.itemid AND c.source_table = 'chartevents'
        WHERE m.stay_id IS NOT NULL AND m.charttime IS NOT NULL""",
    "cv_blab": """
        SELECT m.row_id, m.subject_id, m.hadm_id, s.stay_id, m.itemid, m.charttime, m.value, m.valuenum, m.valueuom,
               d.label, d.category, 'labevents' AS source_table, d.fluid AS source_fluid,
               TRUE AS is_sofa_parameter, c.sofa_system, c.term AS search_term_matched
        FROM cv_lab m JOIN cv_dlabitems d USING (itemid)
        JOIN cv_stays s ON s.subject_id = m.subject_id AND m.charttime BETWEEN s.intime AND s.outtime
        JOIN cv_items c ON c.itemid = m.itemid AND c.source_table = 'labevents'""",
    "cv_bout": f"""
        SELECT m.row_id, m.subject_id, m.hadm_id, m.stay_id, m.itemid, m.charttime, {NUMBER_TEXT.format('m.value')} AS value,
               m.value AS valuenum, m.valueuom, d.label, d.category, 'outputevents' AS source_table,
               CAST(NULL AS VARCHAR) AS source_fluid, TRUE AS is_sofa_parameter, c.sofa_system,
               c.term AS search_term_matched
        FROM cv_out m JOIN cv_ditems d USING (itemid)
        JOIN cv_items c ON c.itemid = m.itemid AND c.source_table = 'outputevents'
        WHERE m.stay_id IS NOT NULL AND m.value > 0""",
    "cv_bin": f"""
        SELECT m.row_id, m.subject_id, m.hadm_id, m.stay_id, m.itemid, m.starttime AS charttime,
               {NUMBER_TEXT.format('m.amount')} AS value, m.amount AS valuenum, m.amountuom AS valueuom, d.label, d.category,
               'inputevents' AS source_table, CAST(NULL AS VARCHAR) AS source_fluid, TRUE AS is_sofa_parameter,
               c.sofa_system, c.term AS search_term_matched
        FROM cv_in m JOIN cv_ditems d USING (itemid)
        JOIN cv_items c ON c.itemid = m.itemid AND c.source_table = 'inputevents'
        WHERE m.stay_id IS NOT NULL AND m.amount > 0""",
    "cv_ball": """
        SELECT * FROM cv_bchart UNION ALL SELECT * FROM cv_blab
        UNION ALL SELECT * FROM cv_bout UNION ALL SELECT * FROM cv_bin""",
    "cv_bunique": """
        SELECT * FROM cv_ball
        QUALIFY valuenum IS NULL OR value IS NULL OR stay_id IS NULL OR row_number() OVER (
            PARTITION BY subject_id, stay_id, itemid, charttime, source_table, value, valuenum ORDER BY row_id) = 1""",
    "cv_bronze": """
        SELECT b.row_id AS id, b.* EXCLUDE (row_id),
               coalesce(b.valuenum < m.min_value OR b.valuenum > m.max_value, FALSE) AS is_outlier,
               coalesce(b.sofa_system IN ('coagulation', 'respiratory') AND b.valuenum < 0, FALSE)
               OR coalesce(b.sofa_system = 'respiratory' AND b.label ILIKE '%spo2%' AND b.valuenum > 100, FALSE)
               OR coalesce(b.sofa_system = 'cns' AND b.label ILIKE '%gcs%' AND b.valuenum > 15, FALSE) AS is_suspicious
        FROM cv_bunique b LEFT JOIN cv_cmap m USING (itemid)""",
    "cv_silver": """
        SELECT b.id AS bronze_id, b.subject_id, b.hadm_id, b.stay_id, b.charttime, b.itemid, b.label, b.category,
               m.concept_id, m.concept_name, b.sofa_system, coalesce(b.search_term_matched, '') AS sofa_parameter_type,
               b.value AS value_original, b.valuenum AS valuenum_original, b.valueuom AS valueuom_original,
               CASE WHEN lower(trim(b.valueuom)) = 'cmh2o' AND lower(trim(m.standard_unit)) = 'mmhg'
                    THEN b.valuenum * (CAST(1.0 AS DOUBLE) / 1.36) ELSE b.valuenum END AS valuenum_std,
               CASE WHEN lower(trim(b.valueuom)) = 'cmh2o' AND lower(trim(m.standard_unit)) = 'mmhg'
                         AND b.valuenum IS NOT NULL THEN m.standard_unit ELSE b.valueuom END AS unit_std,
               b.source_table, b.source_fluid,
               lower(trim(b.valueuom)) = 'cmh2o' AND lower(trim(m.standard_unit)) = 'mmhg'
                         AND b.valuenum IS NOT NULL AS converted,
               CASE WHEN lower(trim(b.valueuom)) = 'cmh2o' AND lower(trim(m.standard_unit)) = 'mmhg'
                         AND b.valuenum IS NOT NULL THEN 'Unit converted: cmh2o → mmhg' ELSE '' END AS transformation_log
        FROM cv_bronze b LEFT JOIN cv_cmap m USING (itemid)
        WHERE NOT b.is_outlier AND NOT b.is_suspicious""",
    # closed daily windows
    "cv_daily": f"""
        WITH o AS (
            SELECT s.*, epoch_us(charttime) - min(epoch_us(charttime)) OVER w AS off,
                   (max(epoch_us(charttime)) OVER w - min(epoch_us(charttime)) OVER w) // {H24} AS last_k,
                   min(charttime) OVER w AS t0
            FROM cv_silver s WHERE valuenum_std IS NOT NULL AND stay_id IS NOT NULL
            WINDOW w AS (PARTITION BY subject_id, stay_id)),
        k AS (SELECT *, off // {H24} + 1 AS k FROM o
              UNION ALL SELECT *, off // {H24} AS k FROM o WHERE off % {H24} = 0 AND off > 0)
        SELECT *, t0 + to_hours(CAST(24 * k AS INTEGER)) AS window_end FROM k WHERE k <= last_k""",
    "cv_agg": """
        SELECT subject_id, stay_id, window_end,
               arg_max(valuenum_std, (charttime, bronze_id)) FILTER (WHERE sofa_system = 'respiratory' AND regexp_matches(concept_name, 'SpO2|Oxygen Saturation', 'i')) AS spo2,
               arg_max(valuenum_std, (charttime, bronze_id)) FILTER (WHERE sofa_system = 'respiratory' AND regexp_matches(concept_name, 'FiO2|Inspired Oxygen', 'i')) AS fio2,
               coalesce(bool_or(regexp_matches(concept_name, 'Ventilator|PEEP|Mechanical', 'i')) FILTER (WHERE sofa_system = 'respiratory'), FALSE) AS ventilated,
               arg_max(valuenum_std, (charttime, bronze_id)) FILTER (WHERE sofa_system = 'cardiovascular' AND regexp_matches(concept_name, 'Mean|MAP', 'i')) AS map_direct,
               arg_max(valuenum_std, (charttime, bronze_id)) FILTER (WHERE sofa_system = 'cardiovascular' AND regexp_matches(concept_name, 'systolic', 'i')) AS sys,
               arg_max(valuenum_std, (charttime, bronze_id)) FILTER (WHERE sofa_system = 'cardiovascular' AND regexp_matches(concept_name, 'diastolic', 'i')) AS dia,
               arg_max(valuenum_std, (charttime, bronze_id)) FILTER (WHERE concept_name = 'Dopamine') AS dopamine,
               arg_max(valuenum_std, (charttime, bronze_id)) FILTER (WHERE concept_name = 'Norepinephrine') AS norepinephrine,
               arg_max(valuenum_std, (charttime, bronze_id)) FILTER (WHERE sofa_system = 'liver' AND concept_name ILIKE '%bilirubin%') AS bilirubin_level,
               arg_max(valuenum_std, (charttime, bronze_id)) FILTER (WHERE sofa_system = 'coagulation' AND concept_name ILIKE '%platelet%') AS platelet_count,
               arg_max(valuenum_std, (charttime, bronze_id)) FILTER (WHERE sofa_system = 'renal' AND concept_name ILIKE '%creatinine%') AS creatinine_level,
               sum(valuenum_std) FILTER (WHERE sofa_system = 'renal' AND regexp_matches(concept_name, 'urine|foley', 'i')) AS urine_output_24h,
               arg_max(valuenum_std, (charttime, bronze_id)) FILTER (WHERE sofa_system = 'cns' AND concept_name ILIKE '%gcs%eye%') AS eye,
               arg_max(valuenum_std, (charttime, bronze_id)) FILTER (WHERE sofa_system = 'cns' AND concept_name ILIKE '%gcs%verbal%') AS verbal,
               arg_max(valuenum_std, (charttime, bronze_id)) FILTER (WHERE sofa_system = 'cns' AND concept_name ILIKE '%gcs%motor%') AS motor
        FROM cv_daily GROUP BY subject_id, stay_id, window_end""",
    "cv_supp": """
        SELECT subject_id, stay_id, window_end, window_end - INTERVAL 24 HOUR AS window_start,
               CASE WHEN fio2 > 0 THEN spo2 * 1.5 / (CASE WHEN fio2 > 1 THEN fio2 / 100 ELSE fio2 END) END AS ratio,
               ventilated, coalesce(map_direct, (2 * dia + sys) / 3) AS map, dopamine, norepinephrine,
               bilirubin_level, platelet_count, creatinine_level, urine_output_24h, eye + verbal + motor AS gcs
        FROM cv_agg""",
    "cv_sub": """
        SELECT *,
          CASE WHEN ratio IS NULL THEN 0 WHEN ratio < 100 AND ventilated THEN 4
               WHEN ratio >= 100 AND ratio < 200 AND NOT ventilated THEN 3 WHEN ratio >= 200 THEN 2 ELSE 0 END AS respiratory_score,
          CASE WHEN dopamine IS NOT NULL OR norepinephrine IS NOT NULL THEN
                    CASE WHEN greatest(dopamine, norepinephrine) >= 15 THEN 4
                         WHEN greatest(dopamine, norepinephrine) >= 5 THEN 3 ELSE 2 END
               WHEN map IS NULL THEN 0 WHEN map >= 70 THEN 0 ELSE 1 END AS cardiovascular_score,
          CASE WHEN bilirubin_level >= 12 THEN 4 WHEN bilirubin_level >= 6 THEN 3 WHEN bilirubin_level >= 2 THEN 2
               WHEN bilirubin_level >= 1.2 THEN 1 ELSE 0 END AS hepatic_score,
          CASE WHEN platelet_count < 20 THEN 4 WHEN platelet_count < 50 THEN 3 WHEN platelet_count < 100 THEN 2
               WHEN platelet_count < 150 THEN 1 ELSE 0 END AS coagulation_score,
          CASE WHEN creatinine_level IS NOT NULL THEN
                    CASE WHEN creatinine_level >= 5 OR urine_output_24h < 200 THEN 4
                         WHEN creatinine_level >= 3.5 OR urine_output_24h < 500 THEN 3
                         WHEN creatinine_level >= 2 THEN 2 WHEN creatinine_level >= 1.2 THEN 1 ELSE 0 END
               WHEN urine_output_24h < 200 THEN 4 WHEN urine_output_24h < 500 THEN 3 ELSE 0 END AS renal_score,
          CASE WHEN gcs <= 5 THEN 4 WHEN gcs <= 9 THEN 3 WHEN gcs <= 12 THEN 2 WHEN gcs <= 14 THEN 1 ELSE 0 END AS neurological_score,
          ratio IS NOT NULL AS respiratory_data_available,
          map IS NOT NULL OR dopamine IS NOT NULL OR norepinephrine IS NOT NULL AS cardiovascular_data_available,
          bilirubin_level IS NOT NULL AS hepatic_data_available,
          platelet_count IS NOT NULL AS coagulation_data_available,
          creatinine_level IS NOT NULL OR urine_output_24h IS NOT NULL AS renal_data_available,
          gcs IS NOT NULL AS neurological_data_available
        FROM cv_supp""",
    "cv_sofa": """
        SELECT subject_id, stay_id, window_end AS charttime, window_start, window_end, respiratory_score,
               cardiovascular_score, hepatic_score, coagulation_score, renal_score, neurological_score,
               respiratory_score + cardiovascular_score + hepatic_score + coagulation_score + renal_score
                 + neurological_score AS total_sofa_score,
               ratio AS pao2_fio2_ratio, map AS mean_arterial_pressure, dopamine, norepinephrine, bilirubin_level,
               platelet_count, creatinine_level, urine_output_24h, gcs AS gcs_total, ventilated,
               respiratory_data_available, cardiovascular_data_available, hepatic_data_available,
               coagulation_data_available, renal_data_available, neurological_data_available,
               (respiratory_data_available::INT + cardiovascular_data_available::INT + hepatic_data_available::INT
                + coagulation_data_available::INT + renal_data_available::INT + neurological_data_available::INT) / 6.0::DOUBLE
                 AS data_completeness_score
        FROM cv_sub""",
}

_NAME = re.compile(r"\bcv_\w+")


def _needed(text: str, seen: list[str]) -> list[str]:
    for name in _NAME.findall(text):
        if name not in seen:
            _needed(VIEWS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def expand_rnd(sql: str) -> str:
    """``rnd(x, n)`` is rounding half away from zero with the same tolerance as ``round_to``."""
    while (at := sql.find("rnd(")) >= 0:
        depth, i, comma = 1, at + 4, -1
        while depth:
            ch = sql[i]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = i
            i += 1
        inner, digits = sql[at + 4 : comma], sql[comma + 1 : i - 1]
        sql = f"{sql[:at]}round(CAST({inner} AS DOUBLE) + sign({inner}) * 1e-9,{digits}){sql[i:]}"
    return sql


def with_views(sql: str) -> str:
    sql = expand_rnd(sql.strip().rstrip(";"))
    names = _needed(sql, [])
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    if re.match(r"(?i)with\b", sql):
        return f"WITH {ctes},\n{sql[4:].lstrip()}"
    return f"WITH {ctes}\n{sql}"
