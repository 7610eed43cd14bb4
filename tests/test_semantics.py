"""Behaviour that a plain rewrite would get wrong."""

from stayscope.functions.columns import small_table
from stayscope.operators import dedup, discovery, extract, quality, windows
from stayscope.plans import policies


def times(spark, rows, schema, *cols):
    return spark.createDataFrame(rows, schema).selectExpr(*[f"cast({c} AS timestamp_ntz) {c}" if c in cols else c for c in [f.split()[0] for f in schema.split(", ")]])


def test_null_keys_never_conflict(spark):
    rows = [(3, 1, None), (1, 1, "a"), (2, 1, "a"), (4, 1, None), (5, None, "a")]
    df = spark.createDataFrame(rows, "id int, k int, v string")
    got = sorted(r["id"] for r in dedup.dedup_unique_key(df, ["k", "v"]).collect())
    assert got == [1, 3, 4, 5]


def test_latest_prefers_null_storetime_and_equal_null_keys(spark):
    df = times(
        spark,
        [(1, 1, 1, "2024-01-01 00:00:00", "2024-01-02 00:00:00"), (2, 1, 1, "2024-01-01 00:00:00", None), (3, 1, None, "2024-01-01 00:00:00", "2024-01-01 00:00:00"), (4, 1, None, "2024-01-01 00:00:00", "2024-01-05 00:00:00")],
        "bronze_id int, subject_id int, itemid int, charttime string, storetime string", "charttime", "storetime",
    )
    assert sorted(r["bronze_id"] for r in dedup.dedup_latest(df).collect()) == [2, 4]


def silver_rows(spark, *hours):
    rows = [(i, 1, 10, f"2024-01-0{1 + h // 24} {h % 24:02d}:00:00") for i, h in enumerate(hours)]
    return times(spark, rows, "id int, subject_id int, stay_id int, charttime string", "charttime")


def test_boundary_event_counts_in_two_daily_windows(spark):
    got = sorted((r["id"], r["window_number"]) for r in windows.daily_windows(silver_rows(spark, 0, 24, 30, 48, 60)).collect())
    assert got == [(0, 1), (1, 1), (1, 2), (2, 2), (3, 2)]


def test_short_stay_has_no_daily_window(spark):
    assert windows.daily_windows(silver_rows(spark, 0, 23)).count() == 0


def test_policy_windows_are_right_closed_and_lose_the_tail(spark):
    got = {r["id"]: r["time_window"] for r in windows.policy_windows(silver_rows(spark, 0, 12, 13, 24, 30), 12).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: None}
    short = {r["id"]: r["time_window"] for r in windows.policy_windows(silver_rows(spark, 0, 5), 12).collect()}
    assert short == {0: None, 1: None}


def test_stay_windows_end_at_discharge(spark):
    stays = times(spark, [(1, 1, 10, "2024-01-01 00:00:00", "2024-01-02 06:00:00")], "subject_id int, hadm_id int, stay_id int, intime string, outtime string", "intime", "outtime")
    got = [(r["window_number"], (r["window_end"] - r["window_start"]).total_seconds() / 3600) for r in windows.stay_windows(stays).orderBy("window_number").collect()]
    assert got == [(1, 24.0), (2, 6.0)]


def test_units_match_in_any_case_and_unknown_pairs_stay(spark):
    df = spark.createDataFrame(
        [(1, 13.6, " CmH2O ", "mmHg"), (2, 100.0, "Celsius", "fahrenheit"), (3, 5.0, "mg", "stone"), (4, None, "cmH2O", "mmHg"), (5, 5.0, None, "mmHg")],
        "id int, valuenum double, valueuom string, standard_unit string",
    )
    got = {r["id"]: (r["valuenum_std"] and round(r["valuenum_std"], 6), r["unit_std"], r["unit_converted"]) for r in quality.convert_units(df, quality.unit_rules(spark)).collect()}
    assert got == {1: (10.0, "mmHg", True), 2: (212.0, "fahrenheit", True), 3: (5.0, "mg", False), 4: (None, "cmH2O", False), 5: (5.0, None, False)}


def test_outlier_flag_uses_value_before_conversion(spark):
    df = spark.createDataFrame([(40.0, 29.4, 0.0, 30.0)], "valuenum double, valuenum_std double, min_value double, max_value double")
    assert quality.flag_outliers_std(df, "original").first()["outlier_detected"] is True
    assert quality.flag_outliers_std(df, "converted").first()["outlier_detected"] is False


def test_limit_rules_keep_their_order(spark):
    df = spark.createDataFrame([("SpO2 Desat Limit",), ("GCS - Motor Response",), ("Oxygen Saturation",), ("Something",)], "label string").selectExpr(
        "label", "'u' AS unit", "cast(1 AS double) AS min_value", "cast(9 AS double) AS max_value"
    )
    got = {r["label"]: (r["standard_unit"], r["limit_low"], r["limit_high"]) for r in discovery.infer_limits(df).collect()}
    assert got == {"SpO2 Desat Limit": ("mmHg", 40.0, 500.0), "GCS - Motor Response": ("points", 3.0, 15.0), "Oxygen Saturation": ("%", 70.0, 100.0), "Something": ("u", 1.0, 9.0)}


def test_cohort_ignores_dots(spark):
    dx = spark.createDataFrame([(1, 1, "J96.01"), (2, 2, "J9601"), (3, 3, "I10")], "subject_id int, hadm_id int, icd_code string")
    assert sorted(r["subject_id"] for r in extract.diagnosis_cohort(dx, ["J96.01"]).collect()) == [1, 2]


def test_paired_join_matches_null_keys(spark):
    cols = "patient_id int, hadm_id int, stay_id int, measurement_time int, apache_ii_score int, sofa_score int, saps_ii_score int, oasis_score int"
    a = spark.createDataFrame([(1, None, 1, 1, 1, 2, 3, 4)], cols)
    assert policies.pair_scores(a, a).count() == 1


def test_median_of_four_is_between_the_middle_values(spark):
    df = small_table(spark, [(1.0,), (2.0,), (4.0,), (8.0,), (None,)], "v double")
    got = sorted(r["v"] for r in policies.impute_columns(df, "median", ["v"]).collect())
    assert got == [1.0, 2.0, 3.0, 4.0, 8.0]


def test_mean_time_is_exact(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00.000001' + make_dt_interval(0, 0, 0, id) AS t FROM range(1001)")
    assert str(df.agg(policies.mean_time("t")).first()[0]) == "2024-01-01 00:08:20.000001"


def test_repartitioned_input_gives_the_same_scores(spark):
    from stayscope.plans.sofa import sofa_scores
    from stayscope.suite.registry import layers_of

    silver = layers_of(spark, "/root/testdata/sf0.001").silver
    one = sofa_scores(silver.repartition(3)).drop("vasopressor_doses")
    two = sofa_scores(silver.repartition(11, "itemid")).drop("vasopressor_doses")
    keys = ["stay_id", "charttime"]
    close = [c for c in one.columns if c not in ("urine_output_24h",)]
    assert one.select(close).orderBy(keys).collect() == two.select(close).orderBy(keys).collect()


def test_schema_validator(spark):
    from stayscope.operators.validate import v_schema

    df = spark.createDataFrame([(1, "x")], "a int, b string")
    got = {r["column_name"]: (r["present"], r["data_type"]) for r in v_schema(df, ["a", "c"]).collect()}
    assert got == {"a": (True, "int"), "c": (False, None)}


def test_a_long_stay_keeps_all_windows(spark):
    from stayscope.operators.windows import stay_windows

    stays = spark.sql("SELECT 1 AS subject_id, 2 AS hadm_id, 3 AS stay_id, timestamp_ntz'2024-01-01 00:00:00' AS intime, timestamp_ntz'2024-02-10 12:00:00' AS outtime")
    assert stay_windows(stays).count() == 41
    assert stay_windows(stays, max_windows=7).count() == 7


def test_close_values_are_narrowed(spark):
    from stayscope.operators.ordered import exact_quantiles

    near = spark.range(100_000).selectExpr("cast(1.7e9 + id AS double) AS v", "'g' AS g")
    assert exact_quantiles(near, ["g"], "v", {"m": 0.5}).first()["m"] == 1.7e9 + 49_999.5


def test_cohort_asks_for_the_code_version(spark):
    from stayscope.operators.extract import diagnosis_cohort

    df = spark.createDataFrame([(1, 1, "J80", 10), (2, 2, "J80", 11), (3, 3, "J80", 9)], "subject_id int, hadm_id int, icd_code string, icd_version int")
    assert sorted(r["subject_id"] for r in diagnosis_cohort(df, ["J80"]).collect()) == [1, 3]


def test_windows_without_events_are_filled_by_the_last_observation(spark):
    from stayscope.functions.columns import small_table
    from stayscope.plans import windowed_gold

    stays = spark.sql("SELECT 1 AS subject_id, 2 AS hadm_id, 3 AS stay_id, timestamp_ntz'2024-01-01 00:00:00' AS intime, timestamp_ntz'2024-01-04 06:00:00' AS outtime")
    events = spark.sql("SELECT 1 AS subject_id, 3 AS stay_id, timestamp_ntz'2024-01-01 20:00:00' AS charttime, 7 AS concept_id, 'c' AS concept_name, 55.0D AS value, 1L AS bronze_id")
    rules = small_table(spark, [("platelets", 7, "min")], "parameter string, concept_id int, aggregation string")
    nobody = events.select("subject_id").limit(0)

    def scored(**settings):
        chosen = windowed_gold.WindowSettings(use_medians=False, **settings)
        rows = windowed_gold.windowed_scores(events, stays, rules, nobody, chosen).orderBy("window_number").collect()
        return [(r["window_number"], r["measurements"], r["platelets"], r["platelets_imputed"], r["sofa_coagulation_subscore"]) for r in rows]

    assert scored() == [(1, 1, 55.0, False, 2)]
    assert scored(min_measurements=0) == [(1, 1, 55.0, False, 2), (2, 0, 55.0, True, 2), (3, 0, None, False, None), (4, 0, None, False, None)]
    assert scored(min_measurements=0, max_windows=2) == scored(min_measurements=0)[:2]
