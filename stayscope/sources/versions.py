"""Tables and artefacts that are replaced whole.

A writer stages a new version in a folder of its own and publishes it by one
rename: a small pointer file with the next number appears, complete. Readers
follow the highest pointer, so they see the old version or the new one and never
a mixture; a writer that dies before the rename leaves nothing that anyone
reads. Frames over an older version stay readable until ``drop_versions``.

Of two writers that publish at once one gets the number, the other an error
and its version stays unpublished. All files are reached through the store of the path.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_VERSIONS, _POINTERS = "versions", "pointers"


class Conflict(RuntimeError):
    """Another writer has published in the meantime."""


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list[str]:
    place, files = _store(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []


def latest(spark: SparkSession, path: str) -> int:
    """Number of the published version, 0 if there is none."""
    return max((int(name) for name in _children(spark, f"{path}/{_POINTERS}") if name.isdigit()), default=0)


def _named(spark: SparkSession, path: str, number: int) -> str:
    place, files = _store(spark, f"{path}/{_POINTERS}/{number:020d}")
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the published version, if there is one."""
    number = latest(spark, path)
    return f"{path}/{_VERSIONS}/{_named(spark, path, number)}" if number else None


def stage(path: str) -> str:
    """Folder for a new version, which no reader looks at before it is published."""
    return f"{path}/{_VERSIONS}/{uuid.uuid4().hex}"


def publish(spark: SparkSession, path: str, version: str, after: int) -> None:
    """Let readers follow the staged folder ``version``, which builds on version number ``after``.

    If another follows that one already, it is a ``Conflict``.
    """
    jvm = spark._jvm
    fresh, files = _store(spark, f"{path}/{_POINTERS}/.{uuid.uuid4().hex}")
    files.mkdirs(fresh.getParent())
    stream = files.create(fresh)
    stream.write(bytearray(version.rstrip("/").rsplit("/", 1)[1].encode()))
    stream.close()
    target, _ = _store(spark, f"{path}/{_POINTERS}/{after + 1:020d}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(fresh), files.makeQualified(target), keep)
    except Py4JJavaError as error:
        files.delete(fresh, False)
        if "FileAlreadyExistsException" in str(error.java_exception):
            raise Conflict(f"{path} has a version {after + 1} already") from None
        raise


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Put ``df`` in the place of the table at ``path``; it may read that table itself. Gives the new version's folder."""
    spark = df.sparkSession
    before, version = latest(spark, path), stage(path)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(version)
    publish(spark, path, version, before)
    return version


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The published version of a table; the frame stays with it when another follows."""
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(version)


def add_batch(df: DataFrame, path: str, batch: int) -> bool:
    """Publish ``df`` as batch number ``batch`` of the table at ``path``, once: a batch that is there already is left as it is.

    For sinks of streams, which may run a batch again after a failure. Such a table is read by ``read_batches``.
    """
    spark = df.sparkSession
    known = _children(spark, f"{path}/{_POINTERS}")
    if f"{batch + 1:020d}" in known:
        return False
    version = stage(path)
    df.write.mode("errorifexists").parquet(version)
    try:
        publish(spark, path, version, batch)
    except Conflict:  # another run of the batch was faster
        return False
    return True


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all published batches."""
    numbers = [int(name) for name in _children(spark, f"{path}/{_POINTERS}") if name.isdigit()]
    if not numbers:
        raise FileNotFoundError(f"nothing is published at {path}")
    return spark.read.parquet(*[f"{path}/{_VERSIONS}/{_named(spark, path, n)}" for n in sorted(numbers)])


def drop_versions(spark: SparkSession, path: str, keep: int = 1, abandoned: bool = False) -> list[str]:
    """Delete all but the last ``keep`` published versions, and on demand what was staged and never published.

    ``abandoned`` is for when no writer is at work: a staged version may be one's work in progress.
    """
    if keep < 1:
        raise ValueError("the published version has to stay")
    last = latest(spark, path)
    numbers = [int(name) for name in _children(spark, f"{path}/{_POINTERS}") if name.isdigit()]
    kept = {_named(spark, path, n) for n in numbers if n > last - keep}
    old = {n: _named(spark, path, n) for n in numbers if n <= last - keep}
    gone = [v for v in _children(spark, f"{path}/{_VERSIONS}") if v not in kept and (abandoned or v in old.values())]
    for name in [f"{_POINTERS}/{n:020d}" for n in old] + [f"{_VERSIONS}/{v}" for v in gone]:
        place, files = _store(spark, f"{path}/{name}")
        files.delete(place, True)
    return gone
