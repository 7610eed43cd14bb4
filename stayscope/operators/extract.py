"""Selection of catalog measurements from the four source tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayscope.functions.columns import contains_any, count_if, hours_between, number_text
from stayscope.operators.dedup import dedup_unique_key
from stayscope.operators.ordered import interval_join

BRONZE_COLUMNS = [
    "subject_id", "hadm_id", "stay_id", "itemid", "charttime", "value", "valuenum", "valueuom",
    "label", "category", "source_table", "source_fluid", "is_sofa_parameter", "sofa_system",
    "search_term_matched",
]
UNIQUE_KEY = ["subject_id", "stay_id", "itemid", "charttime", "source_table", "value", "valuenum"]


def find_items(dictionary: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Dictionary rows whose label contains any of the terms, ordered by label."""
    return dictionary.filter(contains_any("label", terms)).orderBy("label", "itemid")


def extract_chart_basic(chart: DataFrame, itemids: Sequence[int]) -> DataFrame:
    """Numeric chart rows of the listed items without a warning."""
    keep = (
        F.col("itemid").isin(list(itemids))
        & F.col("valuenum").isNotNull()
        & (F.col("warning").isNull() | (F.col("warning") == 0))
    )
    return chart.filter(keep).select(
        *_row_id(chart), "subject_id", "hadm_id", "stay_id", "charttime", "storetime", "itemid",
        "value", "valuenum", "valueuom", F.lit("chartevents").alias("source_table"),
    )


def extract_lab_basic(lab: DataFrame, itemids: Sequence[int], rejected: Sequence[str] = ("abnormal", "error")) -> DataFrame:
    """Numeric lab rows of the listed items whose flag is not rejected; no stay is known."""
    keep = (
        F.col("itemid").isin(list(itemids))
        & F.col("valuenum").isNotNull()
        & (F.col("flag").isNull() | ~F.col("flag").isin(list(rejected)))
    )
    return lab.filter(keep).select(
        *_row_id(lab), "subject_id", "hadm_id", F.lit(None).cast("bigint").alias("stay_id"), "charttime", "storetime",
        "itemid", "value", "valuenum", "valueuom", F.lit("labevents").alias("source_table"),
    )


def _row_id(df: DataFrame) -> list[str]:
    return ["row_id"] if "row_id" in df.columns else []


def _with_catalog(events: DataFrame, dictionary: DataFrame, catalog: DataFrame, source: str) -> DataFrame:
    """Attach dictionary text and catalog system in one join.

    The two dictionaries are joined with each other first; Spark broadcasts the
    result when its measured size allows and shuffles on the item otherwise.
    """
    wanted = catalog.filter(F.col("source_table") == source).select("itemid", "sofa_system", "search_term_matched")
    text = [c for c in ("label", "category", "fluid") if c in dictionary.columns]
    return events.join(dictionary.select("itemid", *text).join(wanted, "itemid"), "itemid")


def _as_bronze(df: DataFrame, source: str, fluid: Column | None = None) -> DataFrame:
    shaped = df.select(
        *_row_id(df),
        "subject_id", "hadm_id", "stay_id", "itemid", "charttime", "value", "valuenum", "valueuom",
        "label", "category", F.lit(source).alias("source_table"),
        (fluid if fluid is not None else F.lit(None).cast("string")).alias("source_fluid"),
        F.lit(True).alias("is_sofa_parameter"), "sofa_system", "search_term_matched",
    )
    return shaped


def bronze_chart(chart: DataFrame, d_items: DataFrame, catalog: DataFrame, need_number: bool = False) -> DataFrame:
    """Chart rows with a stay and a time; text-only values stay unless ``need_number``."""
    rows = chart.filter(F.col("stay_id").isNotNull() & F.col("charttime").isNotNull())
    if need_number:
        rows = rows.filter(F.col("valuenum").isNotNull())
    return _as_bronze(_with_catalog(rows, d_items, catalog, "chartevents"), "chartevents")


def bronze_lab(lab: DataFrame, d_labitems: DataFrame, stays: DataFrame, catalog: DataFrame, need_number: bool = False) -> DataFrame:
    """Lab rows placed into every stay of the patient that contains their time."""
    rows = lab.filter(F.col("charttime").isNotNull())
    if need_number:
        rows = rows.filter(F.col("valuenum").isNotNull())
    rows = _with_catalog(rows, d_labitems, catalog, "labevents")
    spans = stays.select("subject_id", "stay_id", "intime", "outtime")
    placed = interval_join(rows, spans, "subject_id", "charttime", "intime", "outtime")
    return _as_bronze(placed, "labevents", F.col("fluid"))


def bronze_output(outputs: DataFrame, d_items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Output rows with a positive amount."""
    rows = outputs.filter(F.col("stay_id").isNotNull() & F.col("charttime").isNotNull() & (F.col("value") > 0))
    rows = rows.withColumn("valuenum", F.col("value")).withColumn("value", number_text("value"))
    return _as_bronze(_with_catalog(rows, d_items, catalog, "outputevents"), "outputevents")


def bronze_input(inputs: DataFrame, d_items: DataFrame, catalog: DataFrame) -> DataFrame:
    """Input rows with a positive total amount, timed by their start."""
    rows = inputs.filter(F.col("stay_id").isNotNull() & F.col("starttime").isNotNull() & (F.col("amount") > 0))
    rows = rows.select(
        *_row_id(inputs), "subject_id", "hadm_id", "stay_id", "itemid", F.col("starttime").alias("charttime"),
        number_text("amount").alias("value"), F.col("amount").alias("valuenum"), F.col("amountuom").alias("valueuom"),
    )
    return _as_bronze(_with_catalog(rows, d_items, catalog, "inputevents"), "inputevents")


def build_bronze(sources: Sequence[DataFrame]) -> DataFrame:
    """Union of the source extractions, made unique on the layer's key."""
    first, *others = sources
    rows = first
    for other in others:
        rows = rows.unionByName(other)
    if "row_id" in rows.columns:
        rows = rows.withColumnRenamed("row_id", "id")
    else:
        rows = rows.withColumn("id", F.xxhash64(*UNIQUE_KEY))
    return dedup_unique_key(rows.select("id", *BRONZE_COLUMNS), UNIQUE_KEY)


def bronze_rebuild(chart: DataFrame, lab: DataFrame, outputs: DataFrame, d_items: DataFrame, d_labitems: DataFrame, stays: DataFrame, catalog: DataFrame) -> DataFrame:
    """Stricter variant of the bronze layer: three sources, numbers required, no dedup."""
    parts = [
        bronze_chart(chart, d_items, catalog, need_number=True),
        bronze_lab(lab, d_labitems, stays, catalog, need_number=True),
        bronze_output(outputs, d_items, catalog),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def label_items(bronze: DataFrame, d_items: DataFrame, d_labitems: DataFrame) -> DataFrame:
    """Label from the dictionary that belongs to each row's source."""
    icu = d_items.select(F.col("itemid").alias("_icu_item"), F.col("label").alias("_icu_label"))
    lab = d_labitems.select(F.col("itemid").alias("_lab_item"), F.col("label").alias("_lab_label"))
    is_lab = F.col("source_table") == "labevents"
    return (
        bronze.drop("label")
        .join(icu, ~is_lab & (F.col("itemid") == F.col("_icu_item")), "left")
        .join(lab, is_lab & (F.col("itemid") == F.col("_lab_item")), "left")
        .withColumn("label", F.coalesce("_icu_label", "_lab_label"))
        .drop("_icu_item", "_icu_label", "_lab_item", "_lab_label")
    )


def top_items(labelled: DataFrame, n: int = 20) -> DataFrame:
    counts = labelled.groupBy("itemid", "label", "source_table").agg(
        F.count(F.lit(1)).alias("measurements"), F.count_distinct("subject_id").alias("patients")
    )
    return counts.orderBy(F.desc("measurements"), "itemid", "source_table").limit(n)


def sample_items(bronze: DataFrame, itemids: Sequence[int], n: int = 20) -> DataFrame:
    """First rows of the listed items by patient and time; ``limit`` is the feature."""
    rows = bronze.filter(F.col("itemid").isin(list(itemids)) & F.col("valuenum").isNotNull())
    return rows.select("id", "subject_id", "stay_id", "charttime", "itemid", "valuenum", "valueuom").orderBy(
        "subject_id", "charttime", "itemid", "id"
    ).limit(n)


def eligible_stays(stays: DataFrame, min_hours: float | None = None, max_days: float | None = None) -> DataFrame:
    """Stays whose duration lies within the bounds that are given, ends included."""
    kept = stays.withColumn("duration_hours", hours_between("intime", "outtime"))
    if min_hours is not None:
        kept = kept.filter(F.col("duration_hours") >= min_hours)
    if max_days is not None:
        kept = kept.filter(F.col("duration_hours") <= max_days * 24.0)
    return kept


def diagnosis_cohort(diagnoses: DataFrame, codes: Sequence[str], versions: Sequence[int] = (9, 10)) -> DataFrame:
    """Distinct patient and admission with one of the codes in one of the code versions; dots are ignored.

    Without a column ``icd_version`` all codes are of one version.
    """
    if "icd_version" in diagnoses.columns:
        diagnoses = diagnoses.filter(F.col("icd_version").isin(list(versions)))
    plain = [c.replace(".", "") for c in codes]
    return (
        diagnoses.filter(F.regexp_replace("icd_code", r"\.", "").isin(plain))
        .select("subject_id", "hadm_id")
        .distinct()
    )


def label_cohort(stays: DataFrame, cohort: DataFrame, inside: str = "ARI", outside: str = "OTHER") -> DataFrame:
    """Disease label per stay; a patient with any cohort admission counts as inside."""
    members = cohort.select("subject_id").distinct().withColumn("_in", F.lit(True))
    return (
        stays.join(members, "subject_id", "left")
        .withColumn("disease_type", F.when(F.col("_in"), inside).otherwise(outside))
        .drop("_in")
    )


def term_coverage(bronze: DataFrame, terms: DataFrame) -> DataFrame:
    """For each expected term whether any label of its source contains it.

    ``terms`` holds (source_table, term); labels are reduced to the distinct
    ones first, and terms meet only labels of their own source.
    """
    labels = bronze.select("source_table", F.lower("label").alias("_label")).distinct()
    hit = F.col("_label").contains(F.lower("term"))
    return (
        terms.join(labels, "source_table", "left")
        .groupBy("source_table", "term")
        .agg(
            F.coalesce(F.max(hit), F.lit(False)).alias("found"),
            count_if(hit).alias("matching_labels"),
        )
    )
