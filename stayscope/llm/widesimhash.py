"""SimHash near-duplicates at a similarity of word shingles, by wide fingerprints.

At a Jaccard similarity of 0.8 two fingerprints differ in 15 % of their bits,
for which 64 bits are too few to cut. Here a fingerprint has some hundred bits.
It is cut into segments of five groups of bits, and each segment is indexed once
for each of its groups with that group as the wildcard: a variant keeps the other
four. Texts that share a variant are compared by 64 bits outside the segment, what
is left by whole fingerprints, and linked at ``limit`` or fewer differing bits.

Two texts are linked if they pass all three tests. Segments are as many as it takes
for a pair at the given similarity to share a variant in 19 of 20 cases, and
``limit`` lets 19 of 20 pass; nearer pairs pass nearly always, and of pairs below the
similarity some pass, too: about half at 0.75, a sixth at 0.7, none at 0.6. Groups
widen with the logarithm of the number of rows, so that about sixteen unrelated
fingerprints share a variant at most, whatever the size.

Equal sets of shingles collapse first. Fingerprints of one Arrow batch that share
a variant in large numbers are linked before the shuffle and one of each linked
set goes on for that variant, so that a large group of near copies meets as a few
rows a batch; which one goes on differs by variant. The others are held back, not
dropped: once components are known, those whose variant has rows of more than one
component meet all its rows of other components, in pairs of blocks of bounded size,
so every link of the held rows counts, too. Rows of one component need no more links
among themselves. Edges are spanning forests, never all pairs. No row is dropped or capped.

Defined cases: a text of fewer words than the shingle is one shingle of them all;
without words, or for null, the fingerprint is zero and is linked like any other.
Repeated shingles of a text count once. Words are cut at white space, A-Z lower-cased.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayscope.llm.simhash import components
from stayscope.llm.textarrays import NOT_SPACE, firsts, joined, map_slices, mix, range_hash, sequence_hash, text_bytes, whole_groups, words
from stayscope.session import delete_path, written_path, written_table

_GROUPS = 5  # of a segment, one of them the wildcard
_CROWD = 16  # rows of one batch under one variant from which they are linked before the shuffle
_SPAN = 64  # rows under one variant that are compared by their 64 bits; more all go on
_SKETCH_LIMIT = 20  # of 64 bits: 3.5 standard deviations above the mean at 0.8
_BLOCK = 2000  # rows of a block when held rows meet other components
# kinds of rows under a variant: it goes on; it goes on for others of its batch, too; it is held back; an edge; it matters to held rows alone
_SENT, _LEADS, _HELD, _EDGE, _MET = range(5)
_ROWS = "key long, node long, other long, kind byte"


@dataclass(frozen=True)
class Shape:
    """How fingerprints are cut and compared."""

    group_bits: int
    segments: int
    limit: int

    @property
    def longs(self) -> int:
        return -(-self.segments * _GROUPS * self.group_bits // 64)


def shape(rows: int, similarity: float = 0.8, recall: float = 0.95) -> Shape:
    """The shape for a number of rows: pairs at ``similarity`` share a variant, and pass the limit, with ``recall`` each."""
    group_bits = max(5, math.ceil((math.log2(max(rows, 2)) - 4) / (_GROUPS - 1)))
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    alike = (1 - differ) ** group_bits
    shared = alike**_GROUPS + _GROUPS * alike ** (_GROUPS - 1) * (1 - alike)
    segments = math.ceil(math.log(1 - recall) / math.log(1 - shared))
    bits = 64 * Shape(group_bits, segments, 0).longs
    # 1.645 standard deviations above the mean hold 95 %
    return Shape(group_bits, segments, int(bits * differ + 1.645 * math.sqrt(bits * differ * (1 - differ))))


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Hashes of the distinct shingles of each text."""
    data, begin = joined(texts)
    low = np.frombuffer(data.tobytes().lower(), np.uint8)
    start, end = words(low, NOT_SPACE)
    first = firsts(start, begin)
    count = np.diff(first)
    symbols = range_hash(low, start, end, seed=71)
    runs = {k: sequence_hash(symbols, k, seed=72 + k) for k in {*np.unique(np.minimum(count, shingle)).tolist()} - {0}}
    return [np.unique(runs[min(n, shingle)][i : i + max(1, n - shingle + 1)]) if n else np.zeros(0, np.uint64) for i, n in zip(first.tolist(), count.tolist())]


def fingerprint_matrix(texts: list[bytes], shingle: int, longs: int) -> np.ndarray:
    """A row of ``longs`` numbers for each text: a bit is set if over half of the shingles' hashes have it."""
    steps = mix(np.arange(1, longs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros((len(texts), longs), np.uint64)
    for row, hashes in zip(out, shingle_sets(texts, shingle)):
        ones = np.zeros(64 * longs, np.int64)
        # sums of up to 255 rows fit a byte
        for at in range(0, len(hashes), 255):
            wide = mix(hashes[at : at + 255, None] ^ steps)
            ones += np.add.reduce(np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
        row[:] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")
    return out


def _matrix(column: pa.Array | pa.ChunkedArray, longs: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, longs)


def variant_keys(fps: np.ndarray, cut: Shape) -> np.ndarray:
    """Keys of all variants of each fingerprint, a column per segment and wildcard."""
    g = cut.group_bits
    bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")[:, : cut.segments * _GROUPS * g]
    groups = bits.reshape(len(fps), cut.segments, _GROUPS, g).astype(np.int64) @ (1 << np.arange(g))
    out = np.empty((len(fps), cut.segments, _GROUPS), np.int64)
    for wild in range(_GROUPS):
        kept = [k for k in range(_GROUPS) if k != wild]
        out[:, :, wild] = groups[:, :, kept] @ (1 << (g * np.arange(_GROUPS - 1)))
    out |= np.arange(cut.segments * _GROUPS).reshape(1, cut.segments, _GROUPS) << (g * (_GROUPS - 1))
    return out.reshape(len(fps), -1)


def _forest(fps: np.ndarray, limit: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges (places) of a spanning forest of the links between some fingerprints, and a root of each tree."""
    rest, edges, open_, roots = np.arange(len(fps)), [], [], []
    while len(rest) or open_:
        if not open_:
            open_.append(int(rest[0]))
            roots.append(open_[0])
            rest = rest[1:]
            continue
        node = open_.pop()
        near = np.bitwise_count(fps[rest] ^ fps[node]).sum(axis=1, dtype=np.int64) <= limit
        if near.any():
            found = rest[near].tolist()
            edges += [(node, x) for x in found]
            open_ += found
            rest = rest[~near]
    return edges, roots


def _variants(nodes: DataFrame, cut: Shape) -> DataFrame:
    """(key, node, other, kind): variants with 64 bits from outside their segment; and edges found in one batch."""
    half = cut.segments // 2

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            node, fps = batch.column("node").to_numpy(), _matrix(batch.column("fp"), cut.longs)
            keys = variant_keys(fps, cut)
            place = np.repeat(np.arange(len(node)), keys.shape[1])
            upper = np.tile(np.arange(keys.shape[1]) < half * _GROUPS, len(node))
            keys = keys.ravel()
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
            size = np.diff(np.r_[first, len(keys)])
            kind, pairs = np.full(len(keys), _SENT, np.int8), set()
            for at, n in zip(first[size >= _CROWD], size[size >= _CROWD]):
                # another order for each variant, so another root goes on
                own = order[at : at + n]
                own = own[np.argsort(mix(place[own].astype(np.uint64) ^ np.uint64(keys[own[0]])))]
                edges, roots = _forest(fps[place[own]], cut.limit)
                pairs.update((int(place[own[a]]), int(place[own[b]])) for a, b in edges)
                if edges:
                    kind[own] = _HELD
                    kind[own[roots]] = _LEADS
            other = np.where(upper[order], fps[place[order], -1], fps[place[order], 0]).view(np.int64)
            a, b = (node[np.array([p[k] for p in pairs], np.int64)] for k in (0, 1))
            ends = np.full(len(a), -1), np.full(len(a), _EDGE, np.int8)
            yield pa.record_batch([pa.array(np.r_[keys[order], ends[0]]), pa.array(np.r_[node[place[order]], a]), pa.array(np.r_[other, b]), pa.array(np.r_[kind[order], ends[1]])], ["key", "node", "other", "kind"])

    return nodes.mapInArrow(run, _ROWS)


def _candidates(variants: DataFrame) -> DataFrame:
    """The rows of ``variants`` with another row of their key near by 64 bits, the held rows with all others of their key, and the edges."""

    def run(batches):
        for table in whole_groups(batches, ["key"]):
            kind = table.column("kind").to_numpy()
            yield from table.filter(pa.array((kind == _HELD) | (kind == _EDGE))).to_batches()
            table = table.filter(pa.array(kind <= _LEADS))
            key, other, kind = table.column("key").to_numpy(), table.column("other").to_numpy().view(np.uint64), table.column("kind").to_numpy()
            near, at = np.zeros(len(key), bool), np.arange(len(key))
            for step in range(1, _SPAN + 1):
                at = at[at + step < len(key)]
                at = at[key[at] == key[at + step]]
                if not len(at):
                    break
                hit = at[np.bitwise_count(other[at] ^ other[at + step]) <= _SKETCH_LIMIT] if step < _SPAN else at
                near[hit] = near[hit + step] = True
            else:
                # keys of more rows go on whole
                near |= np.isin(key, key[at])
            crowded = np.isin(key, np.unique(key[kind == _LEADS]))
            table = table.set_column(table.schema.get_field_index("kind"), "kind", pa.array(np.where(near, kind, _MET).astype(np.int8)))
            yield from table.filter(pa.array(near | crowded)).to_batches()

    parts = int(variants.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # held rows and edges only pass through, spread by their nodes
    spread = F.when(F.col("kind").isin(_HELD, _EDGE), F.col("node"))
    return variants.repartition(parts, "key", spread).sortWithinPartitions("key").mapInArrow(run, _ROWS)


def _verified(rows: DataFrame, cut: Shape) -> DataFrame:
    """(a, b): a spanning forest of the links between the fingerprints of each key of (key, node, fp)."""

    def run(batches):
        for table in whole_groups(batches, ["key"], rows=10_000):
            key, node, fps = table.column("key").to_numpy(), table.column("node").to_numpy(), _matrix(table.column("fp"), cut.longs)
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            two = first[size == 2]
            near = two[np.bitwise_count(fps[two] ^ fps[two + 1]).sum(axis=1, dtype=np.int64) <= cut.limit]
            found = [np.stack([node[near], node[near + 1]], axis=1)]
            for at, n in zip(first[size > 2], size[size > 2]):
                edges = _forest(fps[at : at + n], cut.limit)[0]
                if edges:
                    found.append(node[at + np.array(edges)])
            both = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _dealt(rows: DataFrame) -> DataFrame:
    """(key, low, high, node, other, root, upper): for rows (key, node, other, root) of keys with several roots, the pairs of blocks they meet in.

    Rows of a key's most frequent root have blocks of their own, which meet all blocks of the
    other rows; these meet each other, too. ``upper`` rows are those of the block ``high``.
    """
    each = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    sizes = each.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "root")).alias("most")).filter("all > most.n")
    blocks = sizes.select("key", F.col("most.root").alias("most"), F.ceil(F.col("most.n") / _BLOCK).alias("a"), F.ceil((F.col("all") - F.col("most.n")) / _BLOCK).alias("b"))
    # a written table, whose size Spark knows
    rows = rows.join(written_table(blocks, "crowd-blocks"), "key")
    large, drawn = F.col("root") == F.col("most"), F.xxhash64("node")
    own = rows.withColumn("block", F.when(large, F.pmod(drawn, "a")).otherwise(F.col("a") + F.pmod(drawn, "b")))
    met = own.withColumn("with", F.explode(F.sequence(F.when(large, F.col("a")).otherwise(F.lit(0)), F.col("a") + F.col("b") - 1)))
    pair = F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high")
    return met.select("key", *pair, "node", "other", "root", (F.col("block") >= F.col("with")).alias("upper"))


def _across(dealt: DataFrame) -> DataFrame:
    """(key, node) of the rows of ``_dealt`` that are near by 64 bits to a row of another root in their pair of blocks; a new key for each pair."""
    names = ["key", "low", "high"]

    def run(batches):
        for table in whole_groups(batches, names, rows=10_000):
            of = [table.column(c).to_numpy() for c in names]
            root, other = table.column("root").to_numpy(), table.column("other").to_numpy().view(np.uint64)
            upper, near = table.column("upper").to_numpy(), np.zeros(table.num_rows, bool)
            first = np.flatnonzero(np.r_[True, np.any([v[1:] != v[:-1] for v in of], axis=0)])
            for a, b in zip(first, np.r_[first[1:], table.num_rows]):
                high = a + np.flatnonzero(upper[a:b])
                low = high if of[1][a] == of[2][a] else a + np.flatnonzero(~upper[a:b])
                for at in range(0, len(high), 200):
                    some = high[at : at + 200, None]
                    hit = (np.bitwise_count(other[some] ^ other[low]) <= _SKETCH_LIMIT) & (root[some] != root[low])
                    near[low[hit.any(axis=0)]] = near[some[hit.any(axis=1), 0]] = True
            yield from table.filter(pa.array(near)).select([*names, "node"]).to_batches()

    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(parts, *names).sortWithinPartitions(*names).mapInArrow(run, "key long, low long, high long, node long")
    return found.select(F.xxhash64(*names).alias("key"), "node")


def _held_links(found: DataFrame, edges: DataFrame, nodes: DataFrame, cut: Shape) -> DataFrame | None:
    """(a, b): what links the held rows of ``found`` to rows of their key in other components of ``edges``; none if no row is held."""
    crowds = written_table(found.filter(F.col("kind") == _HELD).select("key").distinct(), "crowds")
    if crowds.isEmpty():
        return None
    rows = found.filter(F.col("kind") != _EDGE).join(crowds, "key", "left_semi").join(components(edges), "node", "left")
    rows = written_table(rows.select("key", "node", "other", F.coalesce("root", "node").alias("root")), "crowd-rows")
    across = written_table(_across(_dealt(rows)), "crowd-candidates")
    return _verified(across.join(nodes, "node").select("key", "node", "fp"), cut)


def links(nodes: DataFrame, cut: Shape) -> DataFrame:
    """(a, b): edges that connect the linked fingerprints of (node, fp), directly or by steps; ``nodes`` is read two or three times."""
    found, path = written_path(_candidates(_variants(nodes, cut)), "wide-candidates")
    rows = found.filter(F.col("kind") <= _LEADS).select("key", "node").join(nodes, "node").select("key", "node", "fp")
    edges = _verified(rows, cut).unionByName(found.filter(F.col("kind") == _EDGE).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")))
    edges = written_table(edges.distinct(), "wide-links")
    more = _held_links(found, edges, nodes, cut)
    if more is not None:
        edges = written_table(edges.unionByName(more).distinct(), "wide-links")
    delete_path(nodes.sparkSession, path)
    return edges


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component of near copies: the one of the least id, then of the least hash of its text.

    Ids may repeat or be null; a null id comes after all others. Of rows with the same id and text any one stays.
    ``docs`` is read three times, once for its number of rows, which sets the shape of the fingerprints.
    """
    cut = shape(docs.count(), similarity)
    keys = ["_copy_hi", "_copy_lo"]
    # the seed of a hash is what went before, so the second is another function of the text
    keyed = docs.withColumns({keys[0]: F.xxhash64("doc_id", "text"), keys[1]: F.xxhash64(F.lit(1), "doc_id", "text")})

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        fps = fingerprint_matrix(text_bytes(part), shingle, cut.longs)
        return pa.record_batch([part.column("doc_id"), pa.array([x.tobytes() for x in fps], pa.binary()), *map(part.column, keys)], ["doc_id", "fp", *keys])

    each = map_slices(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keys), rows, "doc_id long, fp binary, _copy_hi long, _copy_lo long")
    # rows of equal sets of shingles: their first row; the number of a node is fixed by writing it
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *keys)).alias("row")
    nodes = written_table(each.groupBy("fp").agg(first).withColumn("node", F.monotonically_increasing_id()), "wide-nodes")
    roots = components(links(nodes.select("node", "fp"), cut))
    # the root of a component is no node of ``roots``
    least = nodes.select("node", "row").join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("row").alias("row"))
    kept = least.select(*[F.col(f"row.{c}").alias(c) for c in keys])
    return keyed.join(kept, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
