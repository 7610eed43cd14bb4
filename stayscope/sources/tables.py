"""Readers with explicit schemas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Columns of the clinical source tables
SCHEMAS = {
    "chartevents": "subject_id int, hadm_id int, stay_id int, charttime timestamp_ntz, storetime timestamp_ntz, itemid int, value string, valuenum double, valueuom string, warning int",
    "labevents": "subject_id int, hadm_id int, charttime timestamp_ntz, storetime timestamp_ntz, itemid int, value string, valuenum double, valueuom string, flag string",
    "outputevents": "subject_id int, hadm_id int, stay_id int, charttime timestamp_ntz, itemid int, value double, valueuom string",
    "inputevents": "subject_id int, hadm_id int, stay_id int, starttime timestamp_ntz, itemid int, amount double, amountuom string",
    "d_items": "itemid int, label string, category string, unitname string, param_type string",
    "d_labitems": "itemid int, label string, category string, fluid string",
    "icustays": "subject_id int, hadm_id int, stay_id int, intime timestamp_ntz, outtime timestamp_ntz",
    "admissions": "hadm_id int, hospital_expire_flag int, deathtime timestamp_ntz",
    "diagnoses": "subject_id int, hadm_id int, icd_code string, icd_version int",
}


def read_table(spark: SparkSession, source: str, schema: str | StructType | None = None, jdbc: Mapping[str, str] | None = None) -> DataFrame:
    """Parquet folder, or a database table when ``jdbc`` options are given.

    ``jdbc`` needs ``url`` and, for a parallel read, ``partitionColumn`` with its
    bounds. Missing numbers that arrive as NaN become NULL.
    """
    if jdbc:
        df = spark.read.format("jdbc").options(dbtable=source, **jdbc).load()
    else:
        reader = spark.read.schema(schema) if schema is not None else spark.read
        df = reader.parquet(source)
    return nan_as_null(df)


def nan_as_null(df: DataFrame) -> DataFrame:
    """NaN compares as larger than any number in Spark; the layers expect NULL instead."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def read_csv_typed(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV with a header and a given schema; nothing is inferred."""
    return spark.read.schema(schema).option("header", True).csv(path)
