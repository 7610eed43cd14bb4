"""Row-level flags, limits, units and the projections of the silver layer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayscope.functions.columns import is_true, small_table

# Unit conversions as value * scale + offset, on lower-cased unit names
UNIT_RULES = [
    ("celsius", "fahrenheit", 9.0 / 5.0, 32.0),
    ("fahrenheit", "celsius", 5.0 / 9.0, -160.0 / 9.0),
    ("mmhg", "cmh2o", 1.36, 0.0),
    ("cmh2o", "mmhg", 1.0 / 1.36, 0.0),
    ("ml", "l", 0.001, 0.0),
    ("l", "ml", 1000.0, 0.0),
    ("kg", "g", 1000.0, 0.0),
    ("g", "kg", 0.001, 0.0),
    ("lb", "kg", 0.453592, 0.0),
    ("kg", "lb", 1.0 / 0.453592, 0.0),
]


def unit_rules(spark: SparkSession, rules: Sequence[tuple] = tuple(UNIT_RULES)) -> DataFrame:
    return small_table(spark, list(rules), "from_unit string, to_unit string, scale double, offset double")


def flag_outliers(df: DataFrame, concept_map: DataFrame) -> DataFrame:
    """``is_outlier``: value outside the item's range; unknown item or value is no outlier."""
    limits = concept_map.select("itemid", F.col("min_value").alias("_lo"), F.col("max_value").alias("_hi"))
    outside = (F.col("valuenum") < F.col("_lo")) | (F.col("valuenum") > F.col("_hi"))
    return df.join(limits, "itemid", "left").withColumn("is_outlier", is_true(outside)).drop("_lo", "_hi")


def suspicious(system: Column, label: Column, value: Column) -> Column:
    negative = system.isin("coagulation", "respiratory") & (value < 0)
    saturation = (system == "respiratory") & label.ilike("%spo2%") & (value > 100)
    coma = (system == "cns") & label.ilike("%gcs%") & (value > 15)
    return is_true(negative) | is_true(saturation) | is_true(coma)


def flag_suspicious(df: DataFrame) -> DataFrame:
    """``is_suspicious``: physically impossible values."""
    return df.withColumn("is_suspicious", suspicious(F.col("sofa_system"), F.col("label"), F.col("valuenum")))


def finish_bronze(df: DataFrame, concept_map: DataFrame) -> DataFrame:
    """Both flags plus the layer's bookkeeping columns."""
    flagged = flag_suspicious(flag_outliers(df, concept_map))
    return flagged.withColumn("has_unit_conversion", F.lit(False)).withColumn(
        "extraction_timestamp", F.current_timestamp()
    )


def silver_input(bronze: DataFrame) -> DataFrame:
    """Rows that are neither outlier nor suspicious."""
    stored = F.col("extraction_timestamp") if "extraction_timestamp" in bronze.columns else F.lit(None).cast("timestamp")
    return bronze.filter(~F.col("is_outlier") & ~F.col("is_suspicious")).withColumn("storetime", stored).drop(
        "extraction_timestamp"
    ).withColumnRenamed("id", "bronze_id")


def apply_concepts(df: DataFrame, concept_map: DataFrame) -> DataFrame:
    """Left join to the concept map; unmapped rows keep NULL concept columns."""
    concepts = concept_map.select("itemid", "concept_id", "concept_name", "standard_unit", "min_value", "max_value")
    return df.join(concepts, "itemid", "left")


def enrich_with_concepts(df: DataFrame, concept_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mapped rows, and the distinct items that have no concept."""
    concepts = concept_map.select("itemid", "concept_id", "concept_name", "standard_unit", "min_value", "max_value")
    unmapped = df.select("itemid").distinct().join(concepts, "itemid", "left_anti")
    return df.join(concepts, "itemid"), unmapped


def convert_units(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Standard value and unit; ``unit_converted`` tells whether a rule applied."""
    rules = rules.select(
        F.col("from_unit").alias("_from"), F.col("to_unit").alias("_to"),
        F.col("scale").alias("_scale"), F.col("offset").alias("_offset"),
    )
    have = F.lower(F.trim("valueuom"))
    want = F.lower(F.trim("standard_unit"))
    joined = df.withColumn("_have", have).withColumn("_want", want).join(
        rules, (F.col("_have") == F.col("_from")) & (F.col("_want") == F.col("_to")) & (F.col("_have") != F.col("_want")), "left"
    )
    applied = is_true(F.col("_scale").isNotNull() & F.col("valuenum").isNotNull())
    return (
        joined.withColumn("unit_converted", applied)
        .withColumn("valuenum_std", F.when(applied, F.col("valuenum") * F.col("_scale") + F.col("_offset")).otherwise(F.col("valuenum")))
        .withColumn("unit_std", F.when(applied, F.col("standard_unit")).otherwise(F.col("valueuom")))
        .drop("_have", "_want", "_from", "_to", "_scale", "_offset")
    )


def flag_outliers_std(df: DataFrame, use: str = "original") -> DataFrame:
    """Second outlier test. ``use="original"`` tests the value before conversion,
    ``use="converted"`` the standardised one."""
    tested = F.col("valuenum" if use == "original" else "valuenum_std")
    outside = (tested < F.col("min_value")) | (tested > F.col("max_value"))
    return df.withColumn("outlier_detected", is_true(outside))


def range_note(value: Column, lo: Column | None = None, hi: Column | None = None) -> Column:
    lo = F.col("min_value") if lo is None else lo
    hi = F.col("max_value") if hi is None else hi
    text = [c.cast("string") for c in (value, lo, hi)]
    return F.format_string("Outlier: %s outside [%s, %s]", *text)


def build_flags(df: DataFrame) -> DataFrame:
    """``quality_flags`` map of raised flags and the joined ``transformation_log``."""

    def entry(name: str, raised: Column) -> Column:
        return F.when(raised, F.struct(F.lit(name).alias("key"), F.lit(True).alias("value")))

    converted, outlier = F.col("unit_converted"), F.col("outlier_detected")
    dubious = F.col("is_suspicious") if "is_suspicious" in df.columns else F.lit(False)
    flags = F.map_from_entries(
        F.array_compact(
            F.array(
                entry("UNIT_CONVERTED", converted),
                entry("OUTLIER_DETECTED", outlier),
                entry("SUSPICIOUS_VALUE", dubious),
            )
        )
    )
    log = F.concat_ws(
        "; ",
        F.when(converted, F.format_string("Unit converted: %s → %s", F.lower(F.trim("valueuom")), F.lower(F.trim("standard_unit")))),
        F.when(outlier, range_note(F.col("valuenum"))),
        F.when(dubious, F.lit("Flagged as suspicious in Bronze layer")),
    )
    return df.withColumn("quality_flags", flags).withColumn("transformation_log", log)


def has_flag(name: str) -> Column:
    return is_true(F.map_contains_key("quality_flags", name))


def prepare_silver(df: DataFrame) -> DataFrame:
    """Final silver columns with renamed originals and filled defaults."""
    return df.select(
        "bronze_id", "subject_id", "hadm_id", "stay_id", "charttime", "storetime", "itemid", "label", "category",
        "concept_id", "concept_name",
        F.lit("Measurement").alias("concept_domain"),
        F.lit("MIMIC-IV").alias("vocabulary_id"),
        "sofa_system",
        F.coalesce("search_term_matched", F.lit("")).alias("sofa_parameter_type"),
        F.col("value").alias("value_original"),
        F.col("valuenum").alias("valuenum_original"),
        F.col("valueuom").alias("valueuom_original"),
        "valuenum_std", "unit_std", "source_table", "source_fluid", "quality_flags",
        F.coalesce("transformation_log", F.lit("")).alias("transformation_log"),
    )


def build_silver(bronze: DataFrame, concept_map: DataFrame, rules: DataFrame, use: str = "original") -> DataFrame:
    """Bronze to silver; every step is row-level apart from dictionary joins."""
    mapped = apply_concepts(silver_input(bronze), concept_map)
    return prepare_silver(build_flags(flag_outliers_std(convert_units(mapped, rules), use)))


# First-generation silver -------------------------------------------------


def convert_units_basic(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Case-sensitive conversion with a log text; failures raise ``error_flag``.

    Rules may carry NULL scale for a conversion that is known but fails.
    """
    current = F.coalesce(F.trim("valueuom"), F.lit("unknown"))
    rules = rules.select(
        F.col("from_unit").alias("_from"), F.col("to_unit").alias("_to"),
        F.col("scale").alias("_scale"), F.col("offset").alias("_offset"), F.lit(True).alias("_known"),
    )
    joined = df.withColumn("_unit", current).join(
        rules, (F.col("_unit") == F.col("_from")) & (F.col("standard_unit") == F.col("_to")), "left"
    )
    same = F.lower("_unit") == F.lower("standard_unit")
    known = is_true(F.col("_known")) & ~same
    result = F.col("valuenum") * F.col("_scale") + F.col("_offset")
    done = known & F.col("valuenum").isNotNull() & F.col("_scale").isNotNull()
    failed = known & ~done
    change = F.format_string(
        "Unit converted: %s→%s (%s→%.3f)", F.col("_unit"), F.col("standard_unit"), F.col("valuenum").cast("string"), result
    )
    log = (
        F.when(done, change)
        .when(failed, F.concat(F.lit("Unit conversion failed: "), F.col("_unit"), F.lit("→"), F.col("standard_unit")))
        .when(~same & ~known & (F.col("_unit") != "unknown"), F.concat(F.lit("Unknown unit conversion: "), F.col("_unit")))
        .otherwise(F.lit(""))
    )
    return (
        joined.withColumn("original_unit", F.col("valueuom"))
        .withColumn("original_value", F.col("valuenum"))
        .withColumn("transformation_log", log)
        .withColumn("error_flag", failed)
        .withColumn("valueuom", F.when(same | done, F.col("standard_unit")).otherwise(F.col("valueuom")))
        .withColumn("valuenum", F.when(done, result).otherwise(F.col("valuenum")))
        .withColumn("converted", done)
        .drop("_unit", "_from", "_to", "_scale", "_offset", "_known")
    )


def conversion_counts(df: DataFrame) -> DataFrame:
    """Conversions per unit pair."""
    return (
        df.filter("converted").groupBy(F.col("original_unit").alias("from_unit"), F.col("standard_unit").alias("to_unit"))
        .agg(F.count(F.lit(1)).alias("conversions"))
    )


def append_log(text: Column) -> Column:
    return F.concat_ws("; ", F.nullif(F.col("transformation_log"), F.lit("")), text)


def flag_outliers_basic(df: DataFrame, fallback: DataFrame) -> DataFrame:
    """Outlier by the row's own limits or, where it has none, those of its concept."""
    spare = fallback.select("concept_name", F.col("min_value").alias("_lo"), F.col("max_value").alias("_hi"))
    own = F.col("min_value").isNotNull() & F.col("max_value").isNotNull()
    joined = df.join(spare, "concept_name", "left")
    lo = F.when(own, F.col("min_value")).otherwise(F.col("_lo"))
    hi = F.when(own, F.col("max_value")).otherwise(F.col("_hi"))
    outside = is_true((F.col("valuenum") < lo) | (F.col("valuenum") > hi))
    note = F.when(outside, range_note(F.col("valuenum"), lo, hi))
    return joined.withColumn("is_outlier", outside).withColumn("transformation_log", append_log(note)).drop("_lo", "_hi")


def flag_errors(df: DataFrame) -> DataFrame:
    """Rows without concept or value are errors."""
    broken = F.col("concept_id").isNull() | F.col("valuenum").isNull()
    return df.withColumn("error_flag", broken | is_true(F.col("error_flag")))


def prepare_silver_basic(df: DataFrame) -> DataFrame:
    return df.select(
        "bronze_id", "subject_id", "hadm_id", "stay_id", "charttime", "storetime", "itemid", "concept_name",
        "concept_id", F.col("sofa_system").alias("parameter_type"), F.col("valuenum").alias("value"), "valueuom",
        "source_table",
        F.coalesce("is_outlier", F.lit(False)).alias("is_outlier"),
        F.coalesce("error_flag", F.lit(False)).alias("error_flag"),
        F.coalesce("transformation_log", F.lit("")).alias("transformation_log"),
    )


def silver_rebuild(bronze: DataFrame, concept_map: DataFrame) -> DataFrame:
    """Second-generation silver: in-range numbers times factor, once per matching concept."""
    concepts = concept_map.select(
        "itemid", "concept_id", "concept_name", "standard_unit", "min_value", "max_value", "conversion_factor"
    )
    return (
        bronze.join(concepts, "itemid")
        .filter(F.col("valuenum").between(F.col("min_value"), F.col("max_value")))
        .select(
            "subject_id", "hadm_id", "stay_id", "concept_id", "concept_name", "charttime",
            (F.col("valuenum") * F.col("conversion_factor")).alias("value"), "valueuom", "standard_unit",
            ((F.col("valuenum") < F.col("min_value")) | (F.col("valuenum") > F.col("max_value"))).alias("is_outlier"),
            "sofa_system", F.col("itemid").alias("original_itemid"), "source_table", "conversion_factor",
        )
    )
