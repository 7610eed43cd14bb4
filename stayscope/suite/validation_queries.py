"""Layer validators."""

from __future__ import annotations

from stayscope.operators import validate
from stayscope.suite.registry import query


@query(
    "v8_quality",
    """SELECT source_table, count(*) AS records, count(CASE WHEN valuenum IS NULL THEN 1 END) AS null_valuenum,
              count(CASE WHEN valuenum < 0 THEN 1 END) AS negative_values,
              count(CASE WHEN value IS NULL AND valuenum IS NULL THEN 1 END) AS no_value FROM cv_bronze GROUP BY 1""",
)
def _(x):
    return validate.v_quality(x.bronze)


@query(
    "v9_transformations",
    """SELECT CASE WHEN transformation_log = '' THEN 'none' ELSE 'unit conversion' END AS transformation_type, count(*) AS records
       FROM cv_silver GROUP BY 1""",
)
def _(x):
    return validate.v_transformations(x.silver)


@query("v9_common_logs", "SELECT transformation_log, count(*) AS records FROM cv_silver WHERE contains(transformation_log, 'converted') GROUP BY 1")
def _(x):
    return validate.v_common_logs(x.silver)


@query(
    "v10_concepts",
    """SELECT concept_name, unit_std, count(*) AS records, count(DISTINCT subject_id) AS patients,
              rnd(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY concept_name), 2) AS unit_percent FROM cv_silver GROUP BY 1, 2""",
)
def _(x):
    return validate.v_concepts(x.silver)


@query(
    "v11_limits",
    """SELECT s.concept_id, s.records, rnd(s.lowest, 6) AS lowest, rnd(s.highest, 6) AS highest, s.average, m.concept_name, m.min_value, m.max_value,
              s.lowest >= m.min_value AND s.highest <= m.max_value AS within_limits
       FROM (SELECT concept_id, count(*) AS records, min(valuenum_std) AS lowest, max(valuenum_std) AS highest,
                    rnd(avg(valuenum_std), 4) AS average FROM cv_silver WHERE valuenum_std IS NOT NULL GROUP BY 1) s
       JOIN cv_cmap m USING (concept_id)""",
)
def _(x):
    from stayscope.functions.columns import round_to

    found = validate.v_limits(x.silver, x.views.concept_map)
    return found.withColumns({"lowest": round_to("lowest", 6), "highest": round_to("highest", 6)})


@query(
    "v13_items",
    """SELECT itemid, source_table, count(*) AS records, min(valuenum) AS lowest, max(valuenum) AS highest, rnd(avg(valuenum), 4) AS average
       FROM cv_bronze WHERE valuenum IS NOT NULL GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20""",
)
def _(x):
    return validate.v_items(x.bronze)


@query(
    "v13_time_span",
    """SELECT source_table, min(charttime) AS earliest, max(charttime) AS latest,
              count(DISTINCT CAST(charttime AS DATE)) AS distinct_days FROM cv_bronze GROUP BY 1""",
)
def _(x):
    return validate.v_time_span(x.bronze)


@query(
    "v14_layers",
    """WITH n AS (SELECT (SELECT count(*) FROM cv_bronze) AS b, (SELECT count(*) FROM cv_silver) AS s, (SELECT count(*) FROM cv_sofa) AS g)
       SELECT 'bronze' AS layer, b AS records, TRUE AS present, NULL::DOUBLE AS retention_percent FROM n
       UNION ALL SELECT 'silver', s, TRUE, rnd(s * 100.0 / b, 2) FROM n UNION ALL SELECT 'gold', g, TRUE, rnd(g * 100.0 / s, 2) FROM n""",
)
def _(x):
    return validate.v_layers({"bronze": x.bronze, "silver": x.silver, "gold": x.sofa})
