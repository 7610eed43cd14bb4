"""Texts of an Arrow batch as one byte array, and words or lines as ranges in it.

Tasks see texts in slices of a few MB, so memory follows the slice (or the one
longest text), not the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

SLICE_BYTES = 2 << 20
_SPACE = bytes([9, 10, 11, 12, 13, 32])
#: True for bytes of words cut at white space
NOT_SPACE = np.array([b not in _SPACE for b in range(256)])
#: True for bytes of words of lower-cased text that are digits, a-z or beyond ASCII
WORDLIKE = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with at most ``limit`` bytes of text, or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """``fn`` over every slice of every partition."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, limit):
                yield fn(part)

    return df.mapInArrow(run, schema)


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(batch.column(column).type) else pa.binary()
    return [x or b"" for x in batch.column(column).cast(kind).to_pylist()]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each ended by a newline, and where each begins (with the total length last)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=starts[1:])
    return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), starts


def words(data: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that ``table`` marks; the last byte is a newline."""
    inside = table[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(data) and inside[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def firsts(starts: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Index of the first range of each text, and the number of ranges last."""
    return np.searchsorted(starts, text_starts)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 over unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2 ... modulo 2**64."""
    out = np.full(max(n, 1), np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


#: Ranges of more bytes are hashed by the library, one by one
_LONG_RANGE = 512


def range_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of the bytes of each range, alike wherever the range lies.

    A range of up to ``_LONG_RANGE`` bytes is read eight bytes at a time, all
    ranges at once; each step mixes the next eight into the state, a bijection
    of the state and of the bytes alone, so that no structure of the text
    cancels out as it does in a polynomial modulo a power of two. Longer ranges
    take XXH3 with the seed. Two seeds give two independent halves of 128 bits.
    """
    starts, ends = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
    length = ends - starts
    key = int(np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63))
    state = mix(length.astype(np.uint64) + np.uint64(key))
    loads = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    live = np.flatnonzero((length > 0) & (length <= _LONG_RANGE))
    at = 0
    while len(live):
        left = length[live] - at
        block = loads[starts[live] + at]
        short = left < 8
        block[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        state[live] = mix((state[live] ^ block) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key))
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(length > _LONG_RANGE):
        state[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), key)
    return state


def sequence_hash(symbols: np.ndarray, k: int, seed: int = 2) -> np.ndarray:
    """A hash of each ``k`` consecutive symbols; as many as there are whole runs."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.uint64(int(np.random.Generator(np.random.PCG64(seed)).integers(2**40, 2**61)) * 8 + 5)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * base + symbols[i : i + n]
    return mix(out)


def least_run(gram: np.ndarray, span: int) -> np.ndarray:
    """Position of the least of each ``span`` consecutive values by their upper halves, the first of equals.

    The lower half holds the position, whatever the number of values, so equal runs of values choose alike everywhere.
    """
    n = len(gram)
    low = np.uint64(2**32 - 1)
    cur = (gram & ~low) | np.arange(n, dtype=np.uint64)
    reach = 1
    while 2 * reach <= span:
        cur = np.minimum(cur[:-reach], cur[reach:])
        reach *= 2
    if span > reach:
        cur = np.minimum(cur[: n - span + 1], cur[span - reach : span - reach + n - span + 1])
    return (cur & low).astype(np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Sorted batches put together and cut between groups, so that each table holds whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held)
        change = np.zeros(table.num_rows - 1, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        if change.any():
            cut = int(np.flatnonzero(change)[-1]) + 1
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit numbers as Spark longs of the same bits."""
    return pa.array(x.view(np.int64))


def with_fields(schema: StructType, **fields: DataType) -> StructType:
    """A new schema with more fields; the given one may be a frame's own."""
    return StructType([*schema.fields, *(StructField(k, v) for k, v in fields.items())])


def packed(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, *more, _rest): all other columns in one struct, where their names clash with nothing."""
    kept = ("doc_id", "text", *more)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in kept]
    return docs.select(*kept, F.struct(*rest or [F.lit(0).alias("_")]).alias("_rest"))


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The ``columns`` that a frame had before ``packed``, in their order; ``changed`` replaces some that were in the struct."""
    top = set(df.columns)
    return df.select(*[changed[c].alias(c) if c in changed else F.col(c) if c in ("doc_id", "text") and c in top else F.col("_rest").getField(c).alias(c) for c in columns])
