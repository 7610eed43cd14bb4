"""Preparation of model inputs as fitted stages, and the artefact that holds them with their models.

Imputer, encoder and scaler are fitted by exact aggregates of the training rows and
become SQL stages with those numbers in them, so that one Spark ML pipeline takes
raw rows to predictions and is saved and loaded as a whole.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayscope.operators.models import column_medians
from stayscope.sources import versions


def _text(label: str) -> str:
    return "'" + label.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(v: float) -> str:
    return f"{float(v)!r}D"


def _replacing(columns: Mapping[str, str]) -> SQLTransformer:
    """A stage that puts expressions in the place of columns, or adds them."""
    old = ", ".join(f"`{c}`" for c in columns)
    new = ", ".join(f"{e} AS `{c}`" for c, e in columns.items())
    return SQLTransformer(statement=f"SELECT * EXCEPT ({old}), {new} FROM __THIS__")


def imputer(train: DataFrame, columns: Sequence[str]) -> SQLTransformer:
    """Gaps filled by the exact medians of ``train``; a column without values stays empty."""
    fill = column_medians(train, columns).first()
    return _replacing({c: f"CAST(`{c}` AS DOUBLE)" if fill[c] is None else f"coalesce(CAST(`{c}` AS DOUBLE), {_number(fill[c])})" for c in columns})


def encoder(train: DataFrame, columns: Sequence[str]) -> SQLTransformer:
    """``<c>_encoded``: place of the label among those of ``train`` in alphabetical order, from 0; NULL for others and for none."""
    seen = train.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in columns]).first()  # a label is one of a few
    codes = {c: f"array_position(array({', '.join(map(_text, seen[c]))}), `{c}`)" if seen[c] else "CAST(NULL AS BIGINT)" for c in columns}
    new = ", ".join(f"CAST(nullif({e}, 0) - 1 AS DOUBLE) AS `{c}_encoded`" for c, e in codes.items())
    return SQLTransformer(statement=f"SELECT *, {new} FROM __THIS__")


def scaler(train: DataFrame, columns: Sequence[str]) -> SQLTransformer:
    """Columns centred and divided by the population standard deviation of ``train``."""
    each = [F.struct(F.avg(F.col(c).cast("double")).alias("m"), F.stddev_pop(F.col(c).cast("double")).alias("s")).alias(c) for c in columns]
    stats = train.agg(*each).first()
    return _replacing({c: f"(CAST(`{c}` AS DOUBLE) - {_number(stats[c]['m'] or 0.0)}) / {_number(stats[c]['s'] or 1.0)}" for c in columns})


def fit_preparation(train: DataFrame, numbers: Sequence[str], labels: Sequence[str] = ()) -> PipelineModel:
    """Imputer of ``numbers``, encoder of ``labels`` and scaler of ``numbers``, each fitted to what the one before gives."""
    filled = imputer(train, numbers)
    rows = filled.transform(train)
    stages = [filled, *([encoder(rows, labels)] if labels else []), scaler(rows, numbers)]
    return PipelineModel(stages)


@dataclass(frozen=True)
class Artefact:
    """What predictions need: the preparation, models by name, and how they came about."""

    preparation: PipelineModel
    models: Mapping[str, PipelineModel]
    metadata: Mapping[str, object] = field(default_factory=dict)

    def predict(self, raw: DataFrame, model: str) -> DataFrame:
        return self.models[model].transform(self.preparation.transform(raw))


def save_artefact(artefact: Artefact, path: str) -> str:
    """Save everything as a new version that is published at the end; gives its folder."""
    spark = SparkSession.active()
    before, version = versions.latest(spark, path), versions.stage(path)
    artefact.preparation.write().save(f"{version}/preparation")
    for name, model in artefact.models.items():
        model.write().save(f"{version}/models/{name}")
    kept = {"models": sorted(artefact.models), **artefact.metadata}
    spark.createDataFrame([(json.dumps(kept, sort_keys=True, default=str),)], "value string").coalesce(1).write.text(f"{version}/metadata")
    versions.publish(spark, path, version, before)
    return version


def load_artefact(spark: SparkSession, path: str) -> Artefact:
    """The published version."""
    version = versions.current(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    metadata = json.loads(spark.read.text(f"{version}/metadata").first()["value"])
    models = {name: PipelineModel.load(f"{version}/models/{name}") for name in metadata.pop("models")}
    return Artefact(PipelineModel.load(f"{version}/preparation"), models, metadata)
