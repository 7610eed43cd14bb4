"""SimHash near-duplicates found by deletion variants.

Fingerprints of 64 bits link at ``distance`` or fewer differing bits. They are
cut into two segments, so that for three bits one segment differs by at most one.
Each segment is indexed once for each of its bits with that bit as a wildcard;
fingerprints that share such a variant are verified and linked. Links form
components by alternating large and small stars on written edges.

Copies collapse to one fingerprint first. Rows of one variant are read in order;
a variant with more than ``bucket`` fingerprints is dealt anew by the bytes of
the rest of the fingerprint, of which three differing bits leave one of four
alike, so no link is lost. Inside a bucket a fingerprint leaves the search once
it is linked: edges are a spanning forest, never all pairs.

Defined cases: fewer words than the shingle give one shingle of all; without
words, or for null, the fingerprint is zero and is linked like any other; equal
ids are one document; null ids name no component unless nothing else does.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayscope.llm.textarrays import map_slices, text_bytes
from stayscope.session import written_table

_HALF = 32


def fingerprint_array(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """Unsigned 64-bit fingerprints: a bit is set if it is set in over half of the shingles' hashes."""
    digest, hashes, count = xxhash.xxh64_digest, [], []
    for text in texts:
        found = text.lower().split()
        if len(found) <= shingle:
            count.append(1 if found else 0)
            hashes += [digest(b" ".join(found), 42)] if found else []
            continue
        whole = b" ".join(found)
        size = np.fromiter(map(len, found), np.int64, len(found)) + 1
        start = np.cumsum(size) - size
        end = (start + size - 1)[shingle - 1 :]
        count.append(len(end))
        hashes += [digest(whole[a:b], 42) for a, b in zip(start.tolist(), end.tolist())]
    out = np.zeros(len(texts), np.uint64)
    n = np.array(count, np.int64)
    filled = np.flatnonzero(n)
    if len(filled):
        h = np.frombuffer(b"".join(hashes), ">u8").astype("<u8")
        ones = np.empty((len(filled), 64), np.int64)
        first = (np.cumsum(n) - n)[filled]
        for a, (i, m) in enumerate(zip(first, n[filled])):
            bits = np.unpackbits(h[i : i + m].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[a] = bits.sum(axis=0, dtype=np.int64)
        out[filled] = np.packbits(2 * ones > n[filled, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fp) of every row of (doc_id, text), the fingerprint's bits as a long; long columns ``keys`` pass through."""

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        fp = pa.array(fingerprint_array(text_bytes(part), shingle).view(np.int64))
        return pa.record_batch([part.column("doc_id"), fp, *map(part.column, keys)], ["doc_id", "fp", *keys])

    return map_slices(docs.select("doc_id", "text", *keys), rows, ", ".join(["doc_id long, fp long", *(f"{c} long" for c in keys)]))


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between some fingerprints."""
    rest, edges, open_ = fps.view(np.uint64), [], []
    while len(rest) or open_:
        if not open_:
            open_.append(rest[-1])
            rest = rest[:-1]
            continue
        node = open_.pop()
        near = np.bitwise_count(rest ^ node) <= distance
        if near.any():
            found = rest[near]
            edges += [(int(node.view(np.int64)), int(x)) for x in found.view(np.int64)]
            open_ += list(found)
            rest = rest[~near]
    return edges


def _bucket_links(rows: DataFrame, distance: int, bucket: int, last: bool) -> DataFrame:
    """(a, b, key): edges inside the buckets of (key, value, fp); key -1. Rows of larger buckets come back as (value, fp, key)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "key", "value").sortWithinPartitions("key", "value")

    def run(batches):
        def out(a, b, key):
            return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int32())], ["a", "b", "key"])

        def close(key, value, fps, over):
            if over:
                yield out([value] * len(fps), fps, [key] * len(fps))
            elif len(fps) > 1:
                edges = _forest(fps, distance)
                yield out([a for a, _ in edges], [b for _, b in edges], [-1] * len(edges))

        key = value = None
        held, over = np.zeros(0, np.int64), False
        for batch in batches:
            k, v, f = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "value", "fp"))
            if not len(k):
                continue
            change = np.r_[True, (k[1:] != k[:-1]) | (v[1:] != v[:-1])]
            first = np.flatnonzero(change)
            size = np.diff(np.r_[first, len(k)])
            if key is not None and (k[0], v[0]) == (key, value):
                held = np.r_[held, f[: size[0]]]
                if len(held) > bucket and not last:
                    yield from close(key, value, held, True)
                    held, over = held[:0], True
                first, size = first[1:], size[1:]
            if not len(first):
                continue
            if key is not None:
                yield from close(key, value, held, over)
            # pairs at once, larger buckets one by one; the last may go on in the next batch
            inner, n = first[:-1], size[:-1]
            two = inner[n == 2]
            near = two[np.bitwise_count(f[two].view(np.uint64) ^ f[two + 1].view(np.uint64)) <= distance]
            if len(near):
                yield out(f[near], f[near + 1], np.full(len(near), -1))
            for i in np.flatnonzero(n > 2):
                a, m = inner[i], n[i]
                yield from close(int(k[a]), int(v[a]), f[a : a + m], m > bucket and not last)
            key, value, held, over = k[first[-1]], v[first[-1]], f[first[-1] :].copy(), False
        if key is not None:
            yield from close(int(key), int(value), held, over)

    return dealt.mapInArrow(run, "a long, b long, key int")


def links(distinct: DataFrame, distance: int = 3, bucket: int = 20_000) -> DataFrame:
    """(a, b): edges that connect whatever fingerprints of ``distinct`` (fp) are linked, directly or by steps."""
    if distance > 3:
        raise ValueError("two segments with one wildcard find three differing bits at most")
    ones = (1 << _HALF) - 1
    segment = F.when(F.col("key") < _HALF, F.col("fp").bitwiseAND(F.lit(ones))).otherwise(F.col("fp").bitwiseAND(F.lit(-1 ^ ones)))
    wildcard = F.expr("~shiftleft(1L, key)")
    variants = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(2 * _HALF - 1))).alias("key")).select("key", segment.bitwiseAND(wildcard).alias("value"), "fp")
    found = written_table(_bucket_links(variants, distance, bucket, last=False), "simhash-links")
    # the half outside the segment, a byte at a time; key and value of the bucket stay part of the new value
    other = F.when(F.col("key") < _HALF, F.shiftrightunsigned("b", _HALF)).otherwise(F.col("b").bitwiseAND(F.lit(ones)))
    again = found.filter("key >= 0").select("key", F.col("a"), "b", other.alias("other"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("byte"))
    again = again.select("byte", F.xxhash64("key", "a", "byte", F.expr("shiftrightunsigned(other, 8 * byte) & 255")).alias("value"), F.col("b").alias("fp"))
    more = _bucket_links(again.select(F.col("byte").alias("key"), "value", "fp"), distance, bucket, last=True)
    return found.filter("key < 0").select("a", "b").unionByName(more.select("a", "b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each node of (a, b) can reach."""
    stars = written_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # large star: neighbours above a node hang on to the least around it
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its lower neighbours hang on to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        stars = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        stars = written_table(stars, "stars")
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _with_root(each: DataFrame, distance: int, bucket: int) -> DataFrame:
    """(fp, least, root) of the distinct fingerprints of (doc_id, fp): least id of each and its component."""
    nodes = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), distance, bucket))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, bucket: int = 20_000) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of (doc_id, text); one row per input row."""
    each = written_table(fingerprints(docs, shingle), "fingerprints")
    linked = _with_root(each, distance, bucket)
    group = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(group, "root").select("fp", "component_id")
    return each.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """``docs`` with one row of each component: the one of the least id, then of the least hash of its text.

    Ids may repeat or be null; a null id comes after all others. Of rows with the same id and text any one stays.
    """
    keys = ["_copy_hi", "_copy_lo"]
    # the seed of a hash is what went before, so the second is another function of the text
    keyed = docs.withColumns({keys[0]: F.xxhash64("doc_id", "text"), keys[1]: F.xxhash64(F.lit(1), "doc_id", "text")})
    each = written_table(fingerprints(keyed, shingle, keys), "fingerprints")
    linked = _with_root(each.select("doc_id", "fp"), distance, 20_000).select("fp", "root")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *keys)
    first = each.join(linked, "fp").groupBy("root").agg(F.min(row).alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in keys])
    # dealt by the same keys as the join
    return keyed.join(first, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
