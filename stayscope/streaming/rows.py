"""Row-level steps on streams.

The reference has no streaming of its own. Flags, limits, units, concept joins and
features of single scores keep no state, so they run on a streaming DataFrame as
they are; nothing that needs ordering or grouping is offered here. The sink
publishes each batch once, however often the stream runs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from stayscope.operators import features
from stayscope.operators.quality import build_silver, finish_bronze
from stayscope.sources import versions


def silver_stream(measurements: DataFrame, concept_map: DataFrame, rules: DataFrame) -> DataFrame:
    """Extracted measurements to silver rows; dictionary tables are static."""
    return build_silver(finish_bronze(measurements, concept_map), concept_map, rules)


def feature_stream(scores: DataFrame) -> DataFrame:
    """Labelled scores with the features that follow from a row alone: time, score, clinical thresholds and their products."""
    return features.interactions(features.clinical_features(features.score_features(features.temporal_features(scores))))


def write_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; ``versions.read_batches`` reads the rows.

    A batch becomes visible whole by one rename under its number. If the stream
    repeats it, after a failure or because its checkpoint is lost, the published one stays.
    """

    def publish(batch: DataFrame, number: int) -> None:
        versions.add_batch(batch, path, number)

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
