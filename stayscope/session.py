"""Session and checkpoint settings."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "stayscope") -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="run-warehouse-"))
        .getOrCreate()
    )


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Only for data whose partitioning must stay as it is; see ``written_table``.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``; temporary only in local mode."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="run-shared-")


def written_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back.

    Used where one layer feeds several branches: it is computed once, readers
    prune columns and push filters down, and a lost executor costs nothing but
    its own reads. The files stay until ``delete_written``.
    """
    return written_path(df, name)[0]


def written_path(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As ``written_table``, with the path, for callers that drop the table early."""
    spark = df.sparkSession
    path = f"{_application_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def _application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a written table in whatever store it lies; frames over it cannot be read afterwards."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def delete_written(spark: SparkSession) -> None:
    """Delete all tables that this application wrote; to be called when their results are no longer needed."""
    delete_path(spark, _application_folder(spark))
