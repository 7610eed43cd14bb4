"""The row-level steps run on a stream, checked against the same SQL as in a batch."""

from __future__ import annotations

import uuid

from stayscope.functions.columns import round_to
from stayscope.session import shared_folder
from stayscope.sources import versions
from stayscope.streaming.rows import feature_stream, write_once
from stayscope.suite.feature_queries import labelled
from stayscope.suite.registry import ORACLE, query

SHOWN = {
    "m1_temporal_features": ["hour_of_day", "day_of_week", "is_weekend", "is_early_measurement", "admission_phase"],
    "m2_score_features": ["sofa_components_affected", "sofa_severity_high", "dominant_organ_failure"],
    "m3_clinical_features": ["hypotensive", "aki_stage", "oliguria", "altered_consciousness"],
    "m4_interactions": ["completeness_sofa_interaction", "cardio_renal_interaction"],
}
_JOINED = " JOIN ".join(f"({ORACLE[name]}) {name}" + (" USING (stay_id, charttime)" if i else "") for i, name in enumerate(SHOWN))


@query(
    "m1_m4_stream",
    f"SELECT stay_id, charttime, {', '.join(c for cols in SHOWN.values() for c in cols)} FROM {_JOINED}",
)
def _(x):
    # the stream runs twice, the second time without its checkpoint, so every batch is repeated
    folder = f"{shared_folder(x.spark)}/{x.spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"
    labelled(x).repartition(4).write.parquet(f"{folder}/in")
    for run in range(2):
        rows = x.spark.readStream.schema(labelled(x).schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        write_once(feature_stream(rows), f"{folder}/out", f"{folder}/checkpoint-{run}").awaitTermination()
    out = versions.read_batches(x.spark, f"{folder}/out")
    shown = out.select("stay_id", "charttime", *[c for cols in SHOWN.values() for c in cols])
    return shown.withColumns({"completeness_sofa_interaction": round_to("completeness_sofa_interaction", 6)})
