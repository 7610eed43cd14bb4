"""Nested JSON catalogs as flat tables, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = (
    "struct<itemid: int, label: string, category: string, fluid: string, unit: string, "
    "measurement_count: bigint, patient_count: bigint, stay_count: bigint, min_value: double, max_value: double, "
    "median_value: double, search_term_matched: string>"
)
CONCEPT = (
    "struct<concept_id: int, concept_name: string, source_itemid: string, source_table: string, sofa_system: string, "
    "standard_unit: string, min_value: double, max_value: double, conversion_factor: double, original_unit: string, "
    "measurement_count: bigint, patient_count: bigint>"
)


def _read_map(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """One JSON object per file, parsed as a map with a fixed value type."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", f"map<string, {value_type}>").alias("m"))


def load_item_catalog(spark: SparkSession, path: str) -> DataFrame:
    """System, source and item levels exploded to one row per item."""
    nested = _read_map(spark, path, f"map<string, array<{ITEM}>>")
    systems = nested.select(F.explode("m").alias("sofa_system", "sources"))
    sources = systems.select("sofa_system", F.explode("sources").alias("source_table", "items"))
    rows = sources.select("sofa_system", "source_table", F.inline("items"))
    unit = F.when(~F.lower("unit").isin("none", ""), F.col("unit"))
    return rows.withColumn("unit", unit)


def load_concept_map(spark: SparkSession, path: str) -> DataFrame:
    """Concepts keyed by the source item; of two concepts for one item the later id stays."""
    concepts = _read_map(spark, path, CONCEPT).select(F.explode("m").alias("_key", "c")).select("c.*")
    concepts = concepts.withColumn("itemid", F.expr("try_cast(source_itemid AS int)"))
    rest = [c for c in concepts.columns if c not in ("itemid", "source_itemid")]
    kept = concepts.groupBy("itemid").agg(F.max_by(F.struct(*rest), "concept_id").alias("k"))
    return kept.select("itemid", *[f"k.{c}" for c in rest])


def catalog_json(catalog: DataFrame) -> DataFrame:
    """The nested document as one text row; a catalog is bounded by its dictionary."""
    fields = [c for c in catalog.columns if c not in ("sofa_system", "source_table")]
    per_source = catalog.groupBy("sofa_system", "source_table").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("items")
    )
    per_system = per_source.groupBy("sofa_system").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_table", "items")))).alias("sources")
    )
    whole = per_system.agg(F.map_from_entries(F.collect_list(F.struct("sofa_system", "sources"))).alias("m"))
    return whole.select(F.to_json("m").alias("value"))


def write_catalog_json(catalog: DataFrame, path: str) -> None:
    catalog_json(catalog).write.mode("overwrite").text(path)

