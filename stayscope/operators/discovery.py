"""Finding the items worth extracting, and the catalogs derived from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayscope.functions.columns import small_table
from stayscope.operators.ordered import exact_quantiles
from stayscope.operators.reports import add_distinct

# Search terms per organ system, in matching order
TERMS = {
    "respiratory": [
        "PaO2", "PAO2", "pao2", "arterial oxygen", "SpO2", "SPO2", "spo2", "oxygen saturation", "pulse ox",
        "FiO2", "FIO2", "fio2", "inspired oxygen", "oxygen concentration", "PEEP", "peep",
        "positive end expiratory", "ventilat", "mechanical vent", "vent mode", "respiratory rate", "resp rate",
        "breathing",
    ],
    "cardiovascular": [
        "mean arterial pressure", "MAP", "map", "arterial pressure mean", "blood pressure", "systolic", "diastolic",
        "BP", "norepinephrine", "noradrenaline", "levophed", "epinephrine", "adrenaline", "epi", "dopamine",
        "dobutamine", "vasopressin", "phenylephrine", "neo-synephrine", "vasopressor", "inotrope", "pressor",
    ],
    "coagulation": ["platelet", "PLT", "plt", "thrombocyte", "platelet count", "platelets"],
    "liver": [
        "bilirubin", "BILI", "bili", "total bilirubin", "direct bilirubin", "indirect bilirubin",
        "conjugated bilirubin", "unconjugated bilirubin",
    ],
    "cns": [
        "glasgow coma scale", "GCS", "gcs", "glasgow total", "coma scale", "eye opening", "verbal response",
        "motor response", "neurologic", "consciousness", "mental status",
    ],
    "renal": [
        "creatinine", "CREAT", "creat", "serum creatinine", "urine output", "urine volume", "foley",
        "urinary output", "diuresis", "UO", "kidney function", "renal function",
    ],
}
# Systems searched in each source
SYSTEMS_BY_SOURCE = {
    "chartevents": ["respiratory", "cardiovascular", "cns", "renal"],
    "labevents": ["respiratory", "coagulation", "liver", "renal"],
    "outputevents": ["renal"],
    "inputevents": ["cardiovascular"],
}
# Terms of the second-generation discovery, searched in every source but inputs
TERMS_REBUILD = {
    "respiratory": ["PaO2", "SpO2", "FiO2", "Oxygen", "Ventilat", "PEEP"],
    "cardiovascular": ["Blood Pressure", "MAP", "Dopamine", "Epinephrine", "Norepinephrine", "Vasopressor"],
    "coagulation": ["Platelet", "PLT", "Thrombocyt"],
    "liver": ["Bilirubin", "BILI", "Total Bilirubin"],
    "cns": ["Glasgow", "GCS", "Coma Scale", "Neurologic"],
    "renal": ["Creatinine", "Urine", "Output", "CREAT"],
}
# Fewest rows for an item to be discovered
MIN_COUNT = {"chartevents": 10, "labevents": 10, "outputevents": 10, "inputevents": 5}
SOURCE_ORDER = ["chartevents", "labevents", "outputevents", "inputevents"]


def search_terms(spark: SparkSession, rules: str = "enhanced") -> DataFrame:
    """Term table (sofa_system, system_pos, source_table, pos, term)."""
    terms = TERMS if rules == "enhanced" else TERMS_REBUILD
    rows = []
    for s_pos, (system, words) in enumerate(terms.items()):
        for source in SOURCE_ORDER[:3] if rules == "rebuild" else SOURCE_ORDER:
            if rules == "rebuild" or system in SYSTEMS_BY_SOURCE[source]:
                rows += [(system, s_pos, source, pos, w) for pos, w in enumerate(words)]
    return small_table(spark, rows, "sofa_system string, system_pos int, source_table string, pos int, term string")


def discover_items(events: DataFrame, dictionary: DataFrame, source: str, value: str = "valuenum", unit: str | None = None, positive: bool = False, min_count: int | None = None) -> DataFrame:
    """Statistics per item of one source, items with too few rows left out.

    Rows are first combined per item, patient and stay; only those partial rows
    are counted distinctly and joined to the dictionary.
    """
    at_least = MIN_COUNT[source] if min_count is None else min_count
    rows = events.filter(F.col(value).isNotNull())
    if positive:
        rows = rows.filter(F.col(value) > 0)
    with_stay = "stay_id" in events.columns
    fine_keys = ["itemid", "subject_id", *(["stay_id"] if with_stay else [])]
    fine = rows.groupBy(*fine_keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    stats = fine.groupBy("itemid").agg(
        F.sum("n").alias("measurement_count"),
        F.count_distinct("subject_id").alias("patient_count"),
        F.min("lo").alias("min_value"),
        F.max("hi").alias("max_value"),
    ).filter(F.col("measurement_count") >= at_least)
    # counted apart: two distinct counts in one aggregation would multiply the rows
    stats = add_distinct(stats, fine, ["itemid"], {"stay_count": "stay_id"}) if with_stay else stats.withColumn("stay_count", F.lit(None).cast("bigint"))
    middle = exact_quantiles(rows, ["itemid"], value, {"median_value": 0.5})
    found = stats.join(middle, "itemid").join(dictionary.drop("param_type"), "itemid")
    if unit:
        units = rows.groupBy("itemid", unit).agg(F.count(F.lit(1)).alias("n")).filter(F.col(unit).isNotNull())
        # most frequent unit, the lowest text on ties
        common = units.groupBy("itemid").agg(F.min(F.struct(-F.col("n"), F.col(unit).alias("u")))["u"].alias("unit"))
        found = found.join(common, "itemid", "left")
    else:
        found = found.withColumnRenamed("unitname", "unit")
    fluid = F.col("fluid") if "fluid" in dictionary.columns else F.lit(None).cast("string")
    return found.select(
        "itemid", "label", "category", fluid.alias("fluid"), "unit", F.lit(source).alias("source_table"),
        "measurement_count", "patient_count", "stay_count", "min_value", "max_value", "median_value",
    )


def match_terms(items: DataFrame, terms: DataFrame, first_only: bool = True) -> DataFrame:
    """Items with the system and term they match.

    With ``first_only`` an item appears once per system with its first matching
    term, otherwise once per matching term.
    """
    hit = F.upper("label").contains(F.upper("term"))
    matched = items.join(terms, "source_table").filter(hit)
    if not first_only:
        return matched.withColumnRenamed("term", "search_term_matched").drop("pos", "system_pos")
    # items are dictionary rows, so the groups hold one row per matching term at most
    firsts = matched.groupBy("source_table", "itemid", "sofa_system", "system_pos").agg(
        F.min_by("term", "pos").alias("search_term_matched")
    )
    return firsts.join(items, ["source_table", "itemid"]).drop("system_pos")


def count_items(events: DataFrame, dictionary: DataFrame, source: str) -> DataFrame:
    """Second-generation discovery: row counts only."""
    counts = events.groupBy("itemid").agg(F.count(F.lit(1)).alias("measurement_count"))
    return counts.join(dictionary.select("itemid", "label", "category"), "itemid").withColumn("source_table", F.lit(source))


def _has(*parts: str) -> Column:
    label = F.upper("label")
    test = label.contains(parts[0])
    for p in parts[1:]:
        test = test | label.contains(p)
    return test


def infer_limits(catalog: DataFrame, ruleset: str = "enhanced") -> DataFrame:
    """Standard unit and plausible range from the label, first matching rule first.

    The order is part of the rule: a saturation label that contains ``PO2`` gets
    the oxygen-pressure range.
    """
    label = F.upper("label")
    urine = label.contains("URINE") & label.contains("OUTPUT")
    # Fixed values: (label test, unit, lowest, highest)
    enhanced = [
        (_has("PAO2", "PO2"), "mmHg", 40.0, 500.0),
        (_has("SPO2", "OXYGEN SAT"), "%", 70.0, 100.0),
        (_has("FIO2"), "fraction", 0.21, 1.0),
        (_has("MAP", "MEAN ARTERIAL"), "mmHg", 40.0, 150.0),
        (_has("SYSTOLIC"), "mmHg", 70.0, 250.0),
        (_has("DIASTOLIC"), "mmHg", 30.0, 150.0),
        (_has("NOREPINEPHRINE", "EPINEPHRINE", "DOPAMINE"), "mcg/kg/min", 0.0, 100.0),
        (_has("PLATELET"), "K/uL", 10.0, 1000.0),
        (_has("BILIRUBIN"), "mg/dL", 0.1, 30.0),
        (_has("GCS", "GLASGOW"), "points", 3.0, 15.0),
        (_has("CREATININE"), "mg/dL", 0.3, 15.0),
        (urine, "mL/hr", 0.0, 500.0),
    ]
    rebuild = [
        (_has("PAO2"), "mmHg", 50.0, 500.0),
        (_has("SPO2", "OXYGEN SAT"), "%", 70.0, 100.0),
        (_has("PLATELET", "PLT"), "K/uL", 10.0, 1000.0),
        (_has("CREATININE"), "mg/dL", 0.3, 15.0),
        (_has("BILIRUBIN"), "mg/dL", 0.1, 50.0),
        (_has("GCS", "GLASGOW"), "score", 3.0, 15.0),
        (_has("PRESSURE", "MAP"), "mmHg", 20.0, 200.0),
        (urine, "mL", 0.0, 5000.0),
    ]
    if ruleset == "enhanced":
        rules = enhanced
        other = (F.coalesce("unit", F.lit("")), F.coalesce("min_value", F.lit(0.0)), F.coalesce("max_value", F.lit(1000.0)))
    else:
        rules = rebuild
        other = (F.lit("unit"), F.lit(0.0), F.lit(1_000_000.0))

    def choose(i: int) -> Column:
        chain = F.when(rules[0][0], F.lit(rules[0][i + 1]))
        for rule in rules[1:]:
            chain = chain.when(rule[0], F.lit(rule[i + 1]))
        return chain.otherwise(other[i])

    return catalog.select(
        "*", choose(0).alias("standard_unit"), choose(1).alias("limit_low"), choose(2).alias("limit_high")
    )


def assign_concepts(matched: DataFrame, first_id: int = 3_000_000) -> DataFrame:
    """Concept ids by position in (system, source, frequency) order.

    The input is an item catalog, bounded by the dictionary, so one ordered
    window over it is small.
    """
    system = F.create_map(*[x for i, s in enumerate(TERMS) for x in (F.lit(s), F.lit(i))])
    source = F.create_map(*[x for i, s in enumerate(SOURCE_ORDER) for x in (F.lit(s), F.lit(i))])
    order = W.orderBy(
        F.try_element_at(system, F.col("sofa_system")), F.try_element_at(source, F.col("source_table")),
        F.desc("measurement_count"), "itemid", "search_term_matched",
    )
    return matched.withColumn("concept_id", (F.row_number().over(order) - 1 + first_id).cast("int"))


def discover_all(chart: DataFrame, lab: DataFrame, outputs: DataFrame, inputs: DataFrame, d_items: DataFrame, d_labitems: DataFrame) -> DataFrame:
    """Statistics of the items of all four sources."""
    parts: Sequence[DataFrame] = [
        discover_items(chart, d_items, "chartevents"),
        discover_items(lab.drop("stay_id"), d_labitems, "labevents", unit="valueuom"),
        discover_items(outputs, d_items, "outputevents", value="value", positive=True),
        discover_items(inputs, d_items, "inputevents", value="amount", positive=True),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
