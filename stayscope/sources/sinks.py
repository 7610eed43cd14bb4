"""Writers of layer tables, policy slices, files and models."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CSV_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _flat(df: DataFrame) -> DataFrame:
    """Map columns as JSON text, for sinks without a map type."""
    maps = [f.name for f in df.schema if f.dataType.typeName() in ("map", "struct")]
    return df.withColumns({c: F.to_json(c) for c in maps}) if maps else df


def write_layer(df: DataFrame, table: str, mode: str = "overwrite", partition_by: str | None = None) -> None:
    """Replace (or append to) a managed table."""
    writer = df.write.mode(mode).format("parquet")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.saveAsTable(table)


def write_jdbc(df: DataFrame, table: str, options: Mapping[str, str], truncate: bool = True) -> None:
    """Empty and refill a database table in batches, keeping its definition."""
    options = {"batchsize": "1000", "truncate": str(truncate).lower(), **options}
    _flat(df).write.format("jdbc").options(dbtable=table, **options).mode("overwrite").save()


def write_policy_slice(df: DataFrame, path: str) -> None:
    """Replace only the rows of the policies contained in ``df``."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("config_name").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; timestamps keep their microseconds."""
    writer = _flat(df).write.mode("overwrite").option("header", True)
    writer.option("timestampFormat", CSV_TIME).option("timestampNTZFormat", CSV_TIME).csv(path)


def save_model(model: PipelineModel, path: str, metadata: Mapping[str, object]) -> None:
    """Fitted stages in Spark ML's format and the metadata as one JSON row beside them."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(dict(metadata), sort_keys=True),)], "value string").write.mode("overwrite").text(f"{path}/metadata")


def load_model(path: str) -> tuple[PipelineModel, dict]:
    row = SparkSession.active().read.text(f"{path}/metadata").first()
    return PipelineModel.load(f"{path}/model"), json.loads(row["value"])
