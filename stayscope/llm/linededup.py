"""Lines that many documents share are dropped everywhere.

Normalised lines are exploded and hashed, documents are counted per hash, and
each document is put together again from its other lines, by position.

Defined cases: a null or empty text is one empty line; an empty key never
counts; a line repeated inside one document counts once for it; rows with the
same id are one document for the count and each is cleaned; each row with a
null id is one document of its own; an empty table gives an empty result. Columns beyond the
id and the text pass through ``drop_common_lines`` whatever their names are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from stayscope.llm.textarrays import NOT_SPACE, firsts, joined, map_slices, packed, range_hash, signed, text_bytes, unpacked, with_fields
from stayscope.session import written_table

_SALTS = 16


def _lines(texts: list[bytes]):
    """Ranges of all lines, the first line of each text, and both hashes of each key (0, 0: empty key)."""
    data, begin = joined(texts)
    low = np.frombuffer(data.tobytes().lower(), np.uint8)
    ends = np.flatnonzero(low == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    solid = np.flatnonzero(NOT_SPACE[low])
    i, j = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = j > i
    key_start, key_end = solid[i[some]], solid[j[some] - 1] + 1
    hashes = np.zeros((2, len(starts)), np.uint64)
    for k in (0, 1):
        hashes[k, some] = range_hash(low, key_start, key_end, seed=11 + k)
    return starts, ends, firsts(starts, begin), some, hashes


def _own_text():
    """Tells documents without an id apart; their copies have the same lines to lose."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))


def line_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, own, hi, lo, n) of every line with a key, once per document and key; 128 bits keep other lines apart.

    ``n`` is 1, or the number of rows without an id that have the text ``own``.
    """

    def keys(part: pa.RecordBatch) -> pa.RecordBatch:
        _, _, first, some, hashes = _lines(text_bytes(part))
        of = np.repeat(np.arange(part.num_rows), np.diff(first))[some]
        row = np.unique(np.rec.fromarrays([of, *hashes[:, some]], names="of,hi,lo"))
        of = pa.array(row.of)
        return pa.record_batch([part.column("doc_id").take(of), part.column("own").take(of), signed(row.hi.copy()), signed(row.lo.copy())], ["doc_id", "own", "hi", "lo"])

    each = map_slices(docs.select("doc_id", "text", _own_text().alias("own")), keys, "doc_id long, own long, hi long, lo long")
    return each.groupBy("doc_id", "own", "hi", "lo").agg(F.when(F.col("doc_id").isNull(), F.count("*")).otherwise(1).alias("n"))


def common_lines(docs: DataFrame, min_docs: int) -> DataFrame:
    """(doc_id, own, drop): the keys that each document must lose, for documents that have any.

    The distinct pairs are written once. Counting combines before its shuffle,
    so a line of every document costs one row a task; for the semi join each
    common key is repeated for ``_SALTS`` parts of the documents, so that a hot
    line's documents go to as many tasks.
    """
    pairs = written_table(line_keys(docs), "line-keys")
    often = pairs.groupBy("hi", "lo").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs)
    often = often.select("hi", "lo", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"))
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("doc_id", "own"), F.lit(_SALTS)).cast("int"))
    return dealt.join(often, ["hi", "lo", "salt"], "left_semi").groupBy("doc_id", "own").agg(F.collect_list(F.struct("hi", "lo")).alias("drop"))


def _keep(part: pa.RecordBatch):
    """Kept text, lines and dropped lines of each row."""
    texts = text_bytes(part)
    starts, ends, first, some, (hi, lo) = _lines(texts)
    begin = starts[first[:-1]] if len(texts) else []
    for i, (text, drop) in enumerate(zip(texts, part.column("drop").to_pylist())):
        a, b = first[i], first[i + 1]
        gone = {(d["hi"], d["lo"]) for d in drop or ()}
        if not gone:
            yield text, b - a, 0
            continue
        pairs = zip(hi[a:b].view(np.int64).tolist(), lo[a:b].view(np.int64).tolist(), some[a:b].tolist())
        keep = [not (has and (x, y) in gone) for x, y, has in pairs]
        at = begin[i]
        yield b"\n".join(text[s:e] for s, e, k in zip((starts[a:b] - at).tolist(), (ends[a:b] - at).tolist(), keep) if k), b - a, len(keep) - sum(keep)


def _with_drops(docs: DataFrame, min_docs: int) -> DataFrame:
    drops = common_lines(docs.select("doc_id", "text"), min_docs).select(F.col("doc_id").alias("_drop_id"), F.col("own").alias("_drop_own"), "drop")
    return docs.join(drops, docs["doc_id"].eqNullSafe(drops["_drop_id"]) & (_own_text() == drops["_drop_own"]), "left").drop("_drop_id", "_drop_own")


def drop_common_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """``docs`` with the remaining lines as text; null texts stay null. ``n_chars``, if there, is counted anew."""
    columns = docs.columns
    inner = packed(docs)
    schema = with_fields(inner.schema, _n=LongType())

    def clean(part: pa.RecordBatch) -> pa.RecordBatch:
        kept = [x for x, _, _ in _keep(part)]
        was = part.column("text").is_null().to_pylist()
        text = pa.array([None if null else x.decode() for x, null in zip(kept, was)], pa.string())
        n = pa.array([None if null else len(x.decode()) for x, null in zip(kept, was)], pa.int64())
        return pa.record_batch([part.column("doc_id"), text, part.column("_rest"), n], ["doc_id", "text", "_rest", "_n"])

    out = map_slices(_with_drops(inner, min_docs), clean, schema)
    return unpacked(out, columns, n_chars=F.col("_n"))


def line_report(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row."""

    def report(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(int(n), int(d), hashlib.sha256(x).hexdigest()) for x, n, d in _keep(part)]
        n, dropped, sha = zip(*rows) if rows else ((), (), ())
        return pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return map_slices(_with_drops(docs.select("doc_id", "text"), min_docs), report, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
