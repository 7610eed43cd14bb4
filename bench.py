"""Headline timings as one JSON line.

Layer steps are timed each from the layer before it, as the published run
statistics are; reports read the written layers. Everything runs twice and the
better time counts, so that code generation and class loading stay out. The first
run is in ``first_run``: it also writes the tables that the query shares with others.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stayscope.session import local_session  # noqa: E402
from stayscope.suite.all_queries import QUERIES  # noqa: E402
from stayscope.suite.registry import layers_of  # noqa: E402

REPORTS = [
    "a1_discover_chart", "a9_coverage_by_system", "a14_patient_summaries", "a15_clinical_indicators", "a16_daily_trends",
    "a17_hourly_patterns", "a18_patient_sofa_summary", "a19_daily_sofa_trends", "a22_t12_severity_histogram", "v14_layers",
    "j10_t9_locf", "c17_windowed_scores", "c30_run_mean_policy", "c30_run_median_policy", "s1_s3_s4_s6_compare_scores",
    "t6_j6_time_aware_dataset", "m1_temporal_features", "m5_handle_missing", "t10_temporal_split", "m12_evaluate",
    "a27_aggregate_median", "c31_run_simple_median", "m9_smote", "m10_newton_score_equations",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    layers = layers_of(spark, folder)
    seconds: dict[str, float] = {}
    first_run: dict[str, float] = {}
    rows: dict[str, int] = {}

    def timed(name: str, build) -> None:
        took = []
        for _ in range(2):
            start = time.time()
            build().write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
        seconds[name], first_run[name] = round(min(took), 3), round(took[0], 3)

    for name in ("bronze", "silver", "sofa"):
        timed(f"layer_{name}", lambda name=name: layers.plan_of(name))
        rows[name] = getattr(layers, name).count()
    for name in REPORTS:
        timed(name, lambda name=name: QUERIES[name](spark, folder))
    print(
        json.dumps(
            {
                "metric": "clinical layers and reports, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "first_run": first_run,
                "rows": rows,
                "silver_rows_per_sec": round(rows["silver"] / seconds["layer_silver"]),
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
