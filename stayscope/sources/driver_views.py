"""Clinical-looking views over the driver's event, order and customer tables.

Every view is derived by Spark from the given parquet files, so it grows with
them: each event becomes one or more measurements through a fixed item catalog.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayscope.functions.columns import number_text, small_table

# The item catalog of the stand-in views
# (event_type, slot, itemid, label, category, fluid, system, source, unit, base, scale, modulus, term)
ITEMS = [
    ("view", 0, 220052, "Arterial Blood Pressure mean", "Routine Vital Signs", None, "cardiovascular", "chartevents", "mmHg", 45.0, 0.0, 60, "blood pressure"),
    ("view", 1, 221906, "Norepinephrine", "Medications", None, "cardiovascular", "inputevents", "mg", 0.0, 0.1, 7, "norepinephrine"),
    ("view", 2, 220045, "Heart Rate", "Routine Vital Signs", None, "cardiovascular", "chartevents", "bpm", 60.0, 0.5, 60, "rate"),
    ("click", 3, 220277, "SpO2", "Respiratory", None, "respiratory", "chartevents", "%", 84.0, 0.0, 17, "SpO2"),
    ("click", 4, 223835, "FiO2", "Respiratory", None, "respiratory", "chartevents", "%", 21.0, 0.0, 80, "FiO2"),
    ("click", 5, 220210, "Respiratory Rate", "Respiratory", None, "respiratory", "chartevents", "insp/min", 10.0, 0.1, 20, "respiratory rate"),
    ("click", 6, 220050, "Arterial Blood Pressure systolic", "Routine Vital Signs", None, "cardiovascular", "chartevents", "mmHg", 80.0, 0.0, 90, "blood pressure"),
    ("click", 7, 220051, "Arterial Blood Pressure diastolic", "Routine Vital Signs", None, "cardiovascular", "chartevents", "mmHg", 40.0, 0.0, 60, "blood pressure"),
    ("purchase", 8, 50912, "Creatinine", "Chemistry", "Blood", "renal", "labevents", "mg/dL", 0.2, 0.04, 1, "creatinine"),
    ("purchase", 9, 226559, "Foley", "Output", None, "renal", "outputevents", "mL", 1.0, 5.0, 50, "foley"),
    ("purchase", 10, 50821, "pO2", "Blood Gas", "Blood", "respiratory", "labevents", "mm Hg", 60.0, 0.5, 1, "PaO2"),
    ("signup", 11, 51265, "Platelet Count", "Hematology", "Blood", "coagulation", "labevents", "K/uL", 5.0, 3.0, 1, "platelet"),
    ("signup", 12, 50885, "Bilirubin, Total", "Chemistry", "Blood", "liver", "labevents", "mg/dL", 0.1, 0.05, 1, "bilirubin"),
    ("signup", 13, 220339, "PEEP set", "Respiratory", None, "respiratory", "chartevents", "cmH2O", 4.0, 0.0, 15, "PEEP"),
    ("error", 14, 220739, "GCS - Eye Opening", "Neurological", None, "cns", "chartevents", "points", 1.0, 0.0, 4, "GCS"),
    ("error", 15, 223900, "GCS - Verbal Response", "Neurological", None, "cns", "chartevents", "points", 1.0, 0.0, 5, "GCS"),
    ("error", 16, 223901, "GCS - Motor Response", "Neurological", None, "cns", "chartevents", "points", 1.0, 0.0, 6, "GCS"),
    ("error", 17, 221662, "Dopamine", "Medications", None, "cardiovascular", "inputevents", "mg", 0.0, 0.05, 1, "dopamine"),
]

# Fixed values: (itemid, concept id, standard unit, lowest and highest plausible value)
LIMITS = [
    (220052, 3000000, "mmHg", 50.0, 150.0),
    (221906, 3000001, "mg", 0.0, 100.0),
    (220045, 3000002, "bpm", 30.0, 200.0),
    (220277, 3000003, "%", 70.0, 100.0),
    (223835, 3000004, "%", 21.0, 100.0),
    (220210, 3000005, "insp/min", 5.0, 40.0),
    (220050, 3000006, "mmHg", 70.0, 250.0),
    (220051, 3000007, "mmHg", 30.0, 150.0),
    (50912, 3000008, "mg/dL", 0.3, 15.0),
    (226559, 3000009, "mL", 0.0, 2000.0),
    (50821, 3000010, "mm Hg", 40.0, 250.0),
    (51265, 3000011, "K/uL", 10.0, 1000.0),
    (50885, 3000012, "mg/dL", 0.1, 15.0),
    (220339, 3000013, "mmHg", 0.0, 30.0),
    (220739, 3000014, "points", 1.0, 15.0),
    (223900, 3000015, "points", 1.0, 15.0),
    (223901, 3000016, "points", 1.0, 15.0),
    (221662, 3000017, "mg", 0.0, 100.0),
]


class ClinicalViews:
    """Lazily built views for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def items(self) -> DataFrame:
        return small_table(
            self.spark, ITEMS,
            "event_type string, slot int, itemid int, label string, category string, fluid string, "
            "sofa_system string, source_table string, unit string, base double, scale double, "
            "modulus int, term string",
        )

    @cached_property
    def catalog(self) -> DataFrame:
        """Flat item catalog as the extraction operators expect it."""
        return self.items.select(
            "itemid", "label", "category", "fluid", "source_table", "sofa_system",
            F.col("term").alias("search_term_matched"),
        )

    @cached_property
    def concept_map(self) -> DataFrame:
        limits = small_table(
            self.spark, LIMITS, "itemid int, concept_id int, standard_unit string, min_value double, max_value double"
        )
        return limits.join(F.broadcast(self.items), "itemid").select(
            "itemid", "concept_id", F.col("label").alias("concept_name"), "sofa_system",
            "source_table", "standard_unit", "min_value", "max_value", F.lit(1.0).alias("conversion_factor"),
        )

    @cached_property
    def d_items(self) -> DataFrame:
        rows = self.items.filter("source_table <> 'labevents'")
        return rows.select("itemid", "label", "category", F.col("unit").alias("unitname"), F.lit("Numeric").alias("param_type"))

    @cached_property
    def d_labitems(self) -> DataFrame:
        return self.items.filter("source_table = 'labevents'").select("itemid", "label", "category", "fluid")

    @cached_property
    def measurements(self) -> DataFrame:
        """One row per event and catalog item; every tenth event occurs twice."""
        k = F.get_json_object("props", "$.k").cast("int")
        block = F.when(F.dayofmonth("ts") <= 10, 0).when(F.dayofmonth("ts") <= 20, 1).otherwise(2)
        repeats = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        stored = (
            F.when((F.col("rep") == 1) & (F.col("event_id") % 20 == 0), F.lit(None))
            .when(F.col("rep") == 1, F.expr("ts + INTERVAL '2' HOUR"))
            .otherwise(F.expr("ts + INTERVAL '1' HOUR"))
        )
        # what depends on the event alone is computed before the event is expanded
        events = self.table("events").select(
            "event_id", "event_type", "ts", "value", k.alias("k"), F.col("user_id").alias("subject_id"),
            (F.col("user_id") * 10 + block).alias("stay_id"), F.explode(repeats).alias("rep"),
        )
        # the item catalog is a constant of this module
        return events.join(F.broadcast(self.items), "event_type").select(
            ((F.col("event_id") * 2 + F.col("rep")) * 32 + F.col("slot")).alias("row_id"),
            "event_id",
            "subject_id",
            F.col("stay_id").alias("hadm_id"),
            "stay_id",
            F.col("ts").alias("charttime"),
            stored.alias("storetime"),
            "itemid", "label", "category", "fluid", "sofa_system", "source_table", "unit",
            (F.col("base") + F.col("scale") * F.col("value") + F.col("k") % F.col("modulus")).alias("valuenum"),
        )

    @cached_property
    def chartevents(self) -> DataFrame:
        missing = F.col("event_id") % 40 == 7
        return self.measurements.filter("source_table = 'chartevents'").select(
            "row_id", "subject_id", "hadm_id",
            F.when(F.col("event_id") % 50 != 3, F.col("stay_id")).alias("stay_id"),
            "charttime", "storetime", "itemid",
            F.when(missing, F.lit("unable to obtain")).otherwise(number_text("valuenum")).alias("value"),
            F.when(~missing, F.col("valuenum")).alias("valuenum"),
            F.col("unit").alias("valueuom"),
            F.when(F.col("event_id") % 25 == 0, 1).when(F.col("event_id") % 3 != 0, 0).alias("warning"),
        )

    @cached_property
    def labevents(self) -> DataFrame:
        late = F.col("event_id") % 30 == 11
        return self.measurements.filter("source_table = 'labevents'").select(
            "row_id", "subject_id", "hadm_id",
            F.when(late, F.expr("charttime + INTERVAL '40' DAY")).otherwise(F.col("charttime")).alias("charttime"),
            "storetime", "itemid", number_text("valuenum").alias("value"), "valuenum",
            F.col("unit").alias("valueuom"),
            F.when(F.col("event_id") % 12 == 0, "abnormal").when(F.col("event_id") % 7 == 0, "delta").alias("flag"),
        )

    @cached_property
    def outputevents(self) -> DataFrame:
        return self.measurements.filter("source_table = 'outputevents'").select(
            "row_id", "subject_id", "hadm_id", "stay_id", "charttime", "itemid",
            F.when(F.col("event_id") % 33 == 0, 0.0).otherwise(F.col("valuenum")).alias("value"),
            F.col("unit").alias("valueuom"),
        )

    @cached_property
    def inputevents(self) -> DataFrame:
        return self.measurements.filter("source_table = 'inputevents'").select(
            "row_id", "subject_id", "hadm_id", "stay_id", F.col("charttime").alias("starttime"), "itemid",
            F.col("valuenum").alias("amount"), F.col("unit").alias("amountuom"),
        )

    @cached_property
    def stays(self) -> DataFrame:
        block = F.when(F.dayofmonth("ts") <= 10, 0).when(F.dayofmonth("ts") <= 20, 1).otherwise(2)
        start = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(10 * n)")
        return (
            self.table("events").select(F.col("user_id").alias("subject_id"), block.alias("n")).distinct()
            .select(
                "subject_id",
                (F.col("subject_id") * 10 + F.col("n")).alias("hadm_id"),
                (F.col("subject_id") * 10 + F.col("n")).alias("stay_id"),
                start.alias("intime"),
            )
            .withColumn("outtime", F.expr("intime + INTERVAL '10' DAY"))
        )

    @cached_property
    def admissions(self) -> DataFrame:
        died = F.col("subject_id") % 7 == 0
        gone = F.expr("intime + make_dt_interval(CAST(subject_id % 9 + 1 AS INT))")
        return self.stays.select(
            "subject_id", "hadm_id", F.col("intime").alias("admittime"), F.col("outtime").alias("dischtime"),
            F.when(died, gone).alias("deathtime"),
            died.cast("int").alias("hospital_expire_flag"),
            F.when(F.col("subject_id") % 2 == 0, "EMERGENCY").otherwise("ELECTIVE").alias("admission_type"),
        )

    @cached_property
    def diagnoses(self) -> DataFrame:
        code = (
            F.when(F.col("o_orderpriority") == "1-URGENT", "J96.01")
            .when(F.col("o_orderpriority") == "2-HIGH", "J80")
            .otherwise("I10")
        )
        return self.table("orders").select(
            F.col("o_custkey").alias("subject_id"),
            (F.col("o_custkey") * 10 + F.col("o_orderkey") % 3).alias("hadm_id"),
            code.alias("icd_code"), F.lit(10).alias("icd_version"),
        )

    @cached_property
    def patients(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("subject_id"),
            (F.col("c_custkey") % 70 + 18).cast("int").alias("age"),
            F.when(F.col("c_custkey") % 2 == 0, "F").otherwise("M").alias("gender"),
        )
