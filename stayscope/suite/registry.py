"""Registry of driver queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stayscope.sources.driver_views import ClinicalViews
from stayscope.suite.layers import Layers
from stayscope.suite.sql_views import with_views

_LAYERS: dict[tuple[str, str], Layers] = {}


def layers_of(spark: SparkSession, folder: str) -> Layers:
    """One set of DataFrames per application and folder.

    Layers that several queries read are written once and stay for the
    application, so a folder must not change under it.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _LAYERS:
        _LAYERS[key] = Layers(ClinicalViews(spark, folder))
    return _LAYERS[key]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(layers)``; ``sql`` may name any shared view as ``{view}``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(layers_of(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return register
