"""Merkle manifest of a dataset, verified by one multiproof per leaf partition.

Every row is a leaf. The leaves of a group (a source), in order of their id, are
the bottom of a tree: ``arity`` consecutive nodes become their hash until one is
left. These subroots, in order of their group, are the bottom of a last tree.

Leaves are ordered by a range partitioning and numbered inside their partition;
only counts per group and partition are added up, so no group is in one task.
Partitions are cut into leaf partitions of ``rows`` leaves. Interior nodes are
built in rounds of ``_LEVELS`` levels. A leaf partition then asks for the nodes that its
own leaves do not determine: level by level, the children of its nodes' parents
that it cannot derive, each once, whatever number of proofs runs through them
(the octopus multiproof). It gets them by one join, derives all interior nodes
that its proofs share, up to the root, and expands each leaf's own proof there.

Fields enter a leaf's hash as their length in bytes, a colon and their text; null
is a dash. Defined cases: null groups and ids come first; rows of one id are in
order of their hash; rows that are alike in all have a proof each; an empty table
has no leaves and no root; other columns do not enter the hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayscope.functions.columns import join_null_safe
from stayscope.llm.textarrays import whole_groups
from stayscope.session import written_table

#: The tree over the groups' roots
_TOP = -1
#: Levels that one round builds; a large group is cut into as many tasks as it has nodes that many levels up
_LEVELS = 6
_NODES = "tree long, level int, place long, hash string"


def leaf_hash(fields: Sequence[Column]) -> Column:
    """Hexadecimal SHA-256 of the fields, each with its length."""

    def framed(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[framed(c) for c in fields]).cast("binary"), 256)


def _digest(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def heights(totals: np.ndarray, arity: int) -> np.ndarray:
    """Levels above the leaves of trees with so many leaves."""
    size, out = np.array(totals, np.int64), np.zeros(len(totals), np.int64)
    while (size > 1).any():
        out += size > 1
        size = -(-size // arity)
    return out


def numbered_leaves(leaves: DataFrame, rows: int = 1 << 16) -> tuple[DataFrame, DataFrame]:
    """Leaves (doc_id, leaf, ...) with (part, chunk, tree, place), and the spans (part, chunk, tree, low, n, total) of each leaf partition.

    A leaf has the columns of its span, too.
    """
    # rows alike in all columns are told apart, so a range may end between them
    keyed = leaves.withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf", "_row"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumns({"part": F.spark_partition_id(), "at": at})
    placed = written_table(placed.withColumn("chunk", F.floor(F.col("at") / rows).cast("int")), "ordered-leaves")
    spans = placed.groupBy("part", "chunk", "source").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    along = W.partitionBy("source").orderBy("part", "chunk")
    spans = spans.withColumns({"low": F.coalesce(F.sum("n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(W.partitionBy("source"))})
    spans = written_table(spans, "leaf-spans")
    # groups are numbered like rows: those that begin in earlier partitions, then those before in the same one
    starts = spans.filter("low = 0").select("part", "chunk", "first", "source")
    per_part = starts.groupBy("part").agg(F.count("*").alias("_starts"))
    earlier = per_part.select("part", F.coalesce(F.sum("_starts").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    number = F.row_number().over(W.partitionBy("part").orderBy("chunk", "first")) - 1
    trees = starts.withColumn("_number", number).join(earlier, "part").select("source", (F.col("_number") + F.col("_earlier")).alias("tree"))
    spans = written_table(join_null_safe(spans, trees, ["source"]), "numbered-spans")
    leaves = join_null_safe(placed, spans, ["part", "chunk", "source"])
    leaves = leaves.withColumn("place", F.col("low") + F.col("at") - F.col("first")).drop("at", "first", "source")
    return written_table(leaves, "numbered-leaves"), spans.select("part", "chunk", "tree", "low", "n", "total")


def _climb(tree: np.ndarray, place: np.ndarray, total: np.ndarray, hashes: list[str], arity: int, levels: int) -> Iterator[tuple]:
    """(level, tree, place, size, hashes) of the nodes above whole runs of sorted nodes; ``size`` is each level's number of nodes."""
    size = total
    for level in range(1, levels + 1):
        live = size > 1
        if not live.any():
            return
        tree, place, size = tree[live], place[live], size[live]
        hashes = [h for h, k in zip(hashes, live.tolist()) if k]
        above = place // arity
        cut = np.flatnonzero(np.r_[True, (above[1:] != above[:-1]) | (tree[1:] != tree[:-1])])
        ends = [*cut[1:].tolist(), len(tree)]
        hashes = [_digest(hashes[i:j]) for i, j in zip(cut.tolist(), ends)]
        tree, place, size = tree[cut], above[cut], -(-size[cut] // arity)
        yield level, tree, place, size, hashes


def interior_nodes(bottom: DataFrame, arity: int = 3) -> DataFrame:
    """(tree, level, place, hash): every node above the leaves (tree, place, total, hash) of some trees.

    A round builds ``_LEVELS`` levels from groups of ``arity ** _LEVELS`` nodes; the next starts from their tops.
    """
    spark = bottom.sparkSession
    highest = bottom.agg(F.max("total")).first()[0] or 0
    height = int(heights(np.array([highest]), arity)[0])
    built = [spark.createDataFrame([], _NODES)]
    for low in range(0, height, _LEVELS):
        block = F.floor(F.col("place") / arity**_LEVELS)
        dealt = bottom.select("tree", "place", "total", "hash", block.alias("block"))
        dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")

        def climb(batches, low=low):
            for table in whole_groups(batches, ["tree", "block"]):
                args = (table.column(c).to_numpy() for c in ("tree", "place", "total"))
                for level, tree, place, size, hashes in _climb(*args, table.column("hash").to_pylist(), arity, _LEVELS):
                    yield pa.record_batch([pa.array(tree), pa.array(np.full(len(tree), low + level, np.int32)), pa.array(place), pa.array(hashes), pa.array(size)], ["tree", "level", "place", "hash", "total"])

        nodes = written_table(dealt.mapInArrow(climb, _NODES + ", total long"), "merkle-nodes")
        built.append(nodes.drop("total"))
        bottom = nodes.filter((F.col("level") == low + _LEVELS) & (F.col("total") > 1)).drop("level")
    out = built[0]
    for nodes in built[1:]:
        out = out.unionByName(nodes)
    return out


def missing_nodes(spans: DataFrame, arity: int = 3) -> DataFrame:
    """(part, chunk, tree, level, place): the nodes that leaf partitions with the leaves ``low`` to ``low + n - 1`` of trees cannot derive.

    Of each level only the children at both ends of the known parents are missing, so there are 2 * (arity - 1) at most.
    """

    def ask(batches):
        for b in batches:
            part, chunk, tree, low, n, size = (b.column(c).to_numpy() for c in ("part", "chunk", "tree", "low", "n", "total"))
            high, level = low + n - 1, 0
            while len(size) and size.max() > 1:
                first = low // arity * arity
                last = np.minimum(high // arity * arity + arity, size) - 1
                wanted = []
                for step in range(arity - 1):
                    wanted += [(np.flatnonzero(first + step < low), first + step), (np.flatnonzero(high + 1 + step <= last), high + 1 + step)]
                who = np.concatenate([i for i, _ in wanted])
                place = np.concatenate([p[i] for i, p in wanted])
                if len(who):
                    yield pa.record_batch([pa.array(part[who]), pa.array(chunk[who]), pa.array(tree[who]), pa.array(np.full(len(who), level, np.int32)), pa.array(place)], ["part", "chunk", "tree", "level", "place"])
                low, high, size, level = low // arity, high // arity, -(-size // arity), level + 1

    return spans.mapInArrow(ask, "part int, chunk int, tree long, level int, place long")


def _levels_of(hashes: list[str], low: int, size: int, arity: int, fetched: dict, tree: int) -> tuple[list[tuple[int, list[str]]], str]:
    """Per level the first place and the hashes of all nodes that a run of leaves and the fetched nodes give, and the root."""
    levels, level, high = [], 0, low + len(hashes) - 1
    while size > 1:
        first, last = low // arity * arity, min(high // arity * arity + arity, size) - 1
        hashes = [*(fetched[tree, level, p] for p in range(first, low)), *hashes, *(fetched[tree, level, p] for p in range(high + 1, last + 1))]
        levels.append((first, hashes))
        hashes = [_digest(hashes[i : i + arity]) for i in range(0, len(hashes), arity)]
        low, high, size, level = first // arity, last // arity, -(-size // arity), level + 1
    return levels, hashes[0]


def _siblings(levels: list[tuple[int, list[str]]], place: int, arity: int) -> Iterator[tuple[list[str], list[str]]]:
    """Hashes left and right of the path of one leaf, a pair of lists per level."""
    for first, hashes in levels:
        run = (place // arity * arity) - first
        own = place - first
        yield hashes[run:own], hashes[own + 1 : run + arity]
        place //= arity


def expand_proofs(leaves: DataFrame, fetched: DataFrame, trees: int, arity: int = 3) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root) of every leaf, by leaf partition.

    ``leaves`` are numbered and may have ``seen``, the hash found on checking;
    ``proof`` lists the siblings from below; ``folded_root`` is what they make of ``seen``.
    """

    def expand(own: pa.Table, more: pa.Table) -> pa.Table:
        known = dict(zip(zip(*(more.column(c).to_pylist() for c in ("tree", "level", "place"))), more.column("hash").to_pylist()))
        own = own.sort_by([("tree", "ascending"), ("place", "ascending")])
        tree, place, total = (own.column(c).to_numpy() for c in ("tree", "place", "total"))
        leaf, seen = own.column("leaf").to_pylist(), own.column("seen").to_pylist()
        cut = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]).tolist() if len(tree) else []
        runs, subroots = [], []
        for i, j in zip(cut, [*cut[1:], len(tree)]):
            levels, top = _levels_of(leaf[i:j], int(place[i]), int(total[i]), arity, known, int(tree[i]))
            runs.append((i, j, levels))
            subroots.append(top)
        above, root = _levels_of(subroots, int(tree[0]), trees, arity, known, _TOP) if cut else ([], None)
        out: dict[str, list] = {c: [] for c in ("subroot", "root", "proof", "folded_root")}
        for (i, j, levels), subroot in zip(runs, subroots):
            upper = list(_siblings(above, int(tree[i]), arity))
            for at in range(i, j):
                node, proof = seen[at], []
                for left, right in [*_siblings(levels, int(place[at]), arity), *upper]:
                    node = _digest([*left, node, *right])
                    proof += [*left, *right]
                out["subroot"].append(subroot)
                out["root"].append(root)
                out["proof"].append(proof)
                out["folded_root"].append(node)
        made = [pa.array(v, pa.list_(pa.string()) if c == "proof" else pa.string()) for c, v in out.items()]
        return pa.table([own.column("doc_id"), own.column("leaf"), *made], ["doc_id", "leaf", *out])

    wanted = leaves.select("part", "chunk", "tree", "place", "total", "doc_id", "leaf", "seen").groupBy("part", "chunk")
    schema = "doc_id long, leaf string, subroot string, root string, proof array<string>, folded_root string"
    return wanted.cogroup(fetched.groupBy("part", "chunk")).applyInArrow(expand, schema)


def manifest(leaves: DataFrame, arity: int = 3, rows: int = 1 << 16) -> DataFrame:
    """Proofs, see ``expand_proofs``, for leaves (source, doc_id, leaf, seen); ids are long."""
    placed, spans = numbered_leaves(leaves, rows)
    bottom = placed.select("tree", "place", "total", F.col("leaf").alias("hash"))
    nodes = interior_nodes(bottom, arity)
    # a group's root is the node at its height, or its only leaf
    groups = spans.groupBy("tree").agg(F.max("total").alias("total"))
    trees = groups.count()
    size = groups.agg(F.max("total")).first()[0] or 0
    by_height = [arity**h for h in range(int(heights(np.array([size]), arity)[0]) + 1)]
    height = sum((F.when(F.col("total") > n, 1).otherwise(0) for n in by_height), F.lit(0)).cast("int")
    tops = groups.withColumn("level", height).filter("total > 1").join(nodes.filter("place = 0"), ["tree", "level"]).select("tree", "hash")
    tops = tops.unionByName(bottom.filter("total = 1").select("tree", "hash"))
    top = written_table(tops.select(F.lit(_TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(trees).cast("long").alias("total"), "hash"), "subroots")
    # what is missing beside a leaf partition lies at the end of another
    edge = (F.col("place") < F.col("low") + arity - 1) | (F.col("place") > F.col("low") + F.col("n") - arity)
    ends = placed.filter(edge).select("tree", F.lit(0).alias("level"), "place", F.col("leaf").alias("hash"))
    below = ends.unionByName(top.select("tree", F.lit(0).alias("level"), "place", "hash"))
    nodes = nodes.unionByName(interior_nodes(top, arity)).unionByName(below)
    of_groups = spans.groupBy("part", "chunk").agg(F.min("tree").alias("low"), (F.max("tree") - F.min("tree") + 1).alias("n"))
    of_groups = of_groups.select("part", "chunk", F.lit(_TOP).cast("long").alias("tree"), "low", "n", F.lit(trees).cast("long").alias("total"))
    asked = written_table(missing_nodes(spans.unionByName(of_groups), arity), "missing-nodes")
    fetched = asked.join(nodes, ["tree", "level", "place"])
    return expand_proofs(placed, fetched, trees, arity)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(source, doc_id, leaf, seen) of documents; where the checksum of the id is even, line breaks of the seen text are lost."""
    names = ("doc_id", "source", "lang", "n_chars", "text")
    whole = [F.col(c) for c in names]
    flat = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    lost = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    seen = F.when(lost & F.contains("text", F.lit("\n")), leaf_hash([*whole[:-1], flat])).otherwise(F.col("leaf"))
    return docs.withColumn("leaf", leaf_hash(whole)).select("source", F.col("doc_id").cast("long").alias("doc_id"), "leaf", seen.alias("seen"))


def manifest_report(docs: DataFrame, arity: int = 3, rows: int = 1 << 16) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of documents."""
    proofs = manifest(written_table(document_leaves(docs), "leaves"), arity, rows)
    proof = F.sha2(F.concat_ws("", "proof").cast("binary"), 256)
    return proofs.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
