"""Shards of nearly equal bytes from sampled splitters.

Records are ordered by a hash of their text, then by one of their id and row, so
equal texts lie together and no two records are alike. Size-weighted samples of these keys give quantile
boundaries; records fall into the ranges between them; ranges that are overfull,
or that cross the end of a shard, are subdivided by a new sample of their own.
This goes on until none is left that can be cut. A group of equal texts is cut only if it is larger than ``tolerance`` of a
shard and overfull or crossing. Ranges then go to shards in order.

Only splitters and one sum per range reach the driver: both are bounded by
``ranges`` and ``sample``, whatever the input. Sampling is by hash of the id, so a
retried task draws the same keys.

Defined cases: a null text has size 1 and checksum 0; repeated rows each have a
slot; null ids are ordered first; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from stayscope.llm.textarrays import with_fields
from stayscope.session import written_table

_LOWEST = np.iinfo(np.int64).min
_SCALE = 1 << 40


@dataclass(frozen=True)
class Layout:
    """Lower bounds (text hash, id hash) of the ranges after the first, and each range's rows, bytes, shard and first slot."""

    text: np.ndarray
    ident: np.ndarray
    rows: np.ndarray
    size: np.ndarray
    shard: np.ndarray
    slot: np.ndarray


def record_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, text_key, id_key) of every record."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        # no two rows alike, so that a group of repeated rows can be cut anywhere; fixed once the keys are written
        F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("id_key"),
    )


def _range_of(text: np.ndarray, ident: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Range of each key: the number of bounds at or below it."""
    low, out = np.searchsorted(text, a, "left"), np.searchsorted(text, a, "right")
    for i in np.flatnonzero(out > low):
        out[i] = low[i] + np.searchsorted(ident[low[i] : out[i]], b[i], "right")
    return out


def with_range(keys: DataFrame, text: np.ndarray, ident: np.ndarray) -> DataFrame:
    """``keys`` with their range; a map without a shuffle."""

    def place(batches):
        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("text_key", "id_key"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_range_of(text, ident, a, b).astype(np.int32))], [*batch.schema.names, "range"])

    return keys.mapInArrow(place, with_fields(keys.schema, range=IntegerType()))


def _totals(keys: DataFrame, text: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, size = np.zeros(len(text) + 1, np.int64), np.zeros(len(text) + 1, np.int64)
    for r in with_range(keys, text, ident).groupBy("range").agg(F.count("*").alias("rows"), F.sum("size").alias("size")).collect():
        rows[r["range"]], size[r["range"]] = r["rows"], r["size"]
    return rows, size


def _sample(keys: DataFrame, total: int, sample: int, level: int) -> list:
    """About ``sample`` keys, each drawn with a chance in proportion to its size."""
    chance = F.least(F.lit(1.0), F.col("size") * (sample / max(total, 1)))
    draw = F.pmod(F.xxhash64("text_key", "id_key", F.lit(level)), F.lit(_SCALE)) / float(_SCALE)
    return keys.filter(draw < chance).select("text_key", "id_key", F.greatest(F.lit(1.0), F.col("size") * (sample / max(total, 1))).alias("weight")).collect()


def _quantiles(drawn: list, pieces: int, whole_groups: bool) -> list[tuple[int, int]]:
    drawn = sorted((r["text_key"], r["id_key"], r["weight"]) for r in drawn)
    if not drawn or pieces < 2:
        return []
    upto = np.cumsum([w for *_, w in drawn])
    at = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, pieces) / pieces))
    return [(drawn[i][0], _LOWEST if whole_groups else drawn[i][1]) for i in at]


def plan_shards(keys: DataFrame, shards: int = 8, ranges: int = 512, sample: int = 20_000, tolerance: float = 0.01) -> Layout:
    """Splitters for ``keys``; they are read a few times, so pass a written table."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    bounds = sorted(set(_quantiles(_sample(keys, total, sample, 0), ranges, True)))
    level = 0
    while True:
        level += 1
        text, ident = np.array([b[0] for b in bounds], np.int64), np.array([b[1] for b in bounds], np.int64)
        rows, size = _totals(keys, text, ident)
        upto = np.cumsum(size)
        ends = total * np.arange(1, shards) / shards
        crossing = np.zeros(len(size), bool)
        crossing[np.searchsorted(upto, ends)[: len(size)].clip(max=len(size) - 1)] = True
        split = (rows > 1) & ((size > 2 * total / ranges) | (crossing & (size > tolerance * total / shards)))
        if not split.any():
            break
        chosen = with_range(keys, text, ident).join(F.broadcast(keys.sparkSession.createDataFrame([(int(i),) for i in np.flatnonzero(split)], "range int")), "range")
        drawn: dict[int, list] = {}
        for r in _sample(chosen, int(size[split].sum()), sample, level):
            drawn.setdefault(int(_range_of(text, ident, np.array([r["text_key"]]), np.array([r["id_key"]]))[0]), []).append(r)
        more = [b for i, d in drawn.items() for b in _quantiles(d, max(16, int(2 * size[i] * ranges / max(total, 1))), level == 1)]
        if not set(more) - set(bounds) and level > 1:
            break  # what is overfull is a single large row
        bounds = sorted({*bounds, *more})
    middle = upto - size / 2
    shard = np.minimum((middle * shards / max(total, 1)).astype(np.int64), shards - 1)
    before = np.cumsum(rows) - rows
    first = np.array([before[np.argmax(shard == s)] if (shard == s).any() else 0 for s in range(shards)], np.int64)
    return Layout(text, ident, rows, size, shard, before - first[shard])


def assign(keys: DataFrame, layout: Layout) -> DataFrame:
    """``keys`` with ``shard`` and ``slot``; rows are numbered inside their range, which no hot group overfills."""
    spark = keys.sparkSession
    table = spark.createDataFrame([(i, int(s), int(o)) for i, (s, o) in enumerate(zip(layout.shard, layout.slot))], "range int, shard int, first long")
    order = Window.partitionBy("range").orderBy("text_key", "id_key", "doc_id", "size")
    placed = with_range(keys, layout.text, layout.ident).withColumn("_n", F.row_number().over(order))
    # one row per range: at most a few thousand
    return placed.join(F.broadcast(table), "range").withColumn("slot", (F.col("first") + F.col("_n") - 1).cast("long")).drop("first", "_n", "range")


def shard_table(docs: DataFrame, shards: int = 8, **limits) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of (doc_id, text)."""
    keys = written_table(record_keys(docs), "shard-keys")
    placed = assign(keys, plan_shards(keys, shards, **limits))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, **limits) -> None:
    """Write (doc_id, text) as one folder per shard; texts do not pass a join."""
    keys = written_table(record_keys(docs), "shard-keys")
    layout = plan_shards(keys, shards, **limits)
    own = record_keys(docs).schema.names
    with_keys = docs.select("doc_id", "text").select("text", *[F.col("doc_id") if c == "doc_id" else _key_column(c).alias(c) for c in own])
    placed = with_range(with_keys, layout.text, layout.ident)
    table = docs.sparkSession.createDataFrame([(i, int(s)) for i, s in enumerate(layout.shard)], "range int, shard int")
    placed.join(F.broadcast(table), "range").select("doc_id", "text", "shard").write.partitionBy("shard").parquet(path)


def _key_column(name: str):
    return {"size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"), "text_crc32": F.lit(0).cast("long"), "text_key": F.xxhash64(F.coalesce("text", F.lit(""))), "id_key": F.xxhash64("doc_id", F.monotonically_increasing_id())}[name]
