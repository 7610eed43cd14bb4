"""Exact nearest neighbours in bounded blocks.

Equal points are collapsed first: a group of them is one point with its ``k + 1``
least ids, so a hot point costs no more than its rows. The others are turned to the
axes of greatest spread and dealt to the leaves of a k-d tree over a sample; leaves
are cut by row numbers, so no block grows with skew. Each block first searches
itself, which bounds the distance of every row's k-th neighbour.

Blocks lie under a tree of bounding boxes. Pairs of nodes descend it by equality
joins while their boxes are near enough for what the left one's rows look for, down to
groups of blocks; one task searches one group for the rows of another. There, a row
meets just the blocks whose box is within its bound, nearest first, and each
neighbour found tightens the bound. Nothing is missed.

Work is near linear while few boxes are within the bound. In many dimensions of
equal spread nearly all are, and the work becomes quadratic, as it must for exact
results; it is then one matrix product and one comparison per two blocks, each row
travels once per group that it meets, and only neighbours leave a task.
Coordinates have to be finite. Runs at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayscope.operators.ordered import global_positions, settled
from stayscope.session import written_table

CANDIDATES = "id long, other long, d double"
#: Rows that place the cuts of the tree; what they miss only makes blocks less even
_SAMPLE = 20_000
_LEAF_SAMPLE = 16
_BOX = "node long, lo array<double>, hi array<double>, far double"
#: Children of a node in the tree of boxes, and blocks of a group at most
_FAN = 32
#: Groups that are made of few blocks, so that there is a task for every core
_GROUPS = 12
#: Rows that meet a block at once
_ROWS = 512


def _top(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` nearest of ``others`` by (distance, id), never a row itself."""
    found = [pd.DataFrame({"id": np.array([], "int64"), "other": np.array([], "int64"), "d": np.array([], "float64")})]
    centre = y.mean(axis=0)
    yc = y - centre
    y2 = (yc**2).sum(1)
    for a in range(0, len(ids), 256):
        xc = x[a : a + 256] - centre
        d = (xc**2).sum(1)[:, None] + y2[None, :] - 2.0 * xc @ yc.T
        own = ids[a : a + 256, None] == others[None, :]
        d[own] = np.inf
        take = min(k, d.shape[1])
        # the fast formula only preselects, with room for its rounding; exact distances decide
        room = 1e-10 * ((xc**2).sum(1) + y2.max())
        row, col = np.nonzero((d <= (np.partition(d, take - 1, axis=1)[:, take - 1] + room)[:, None]) & ~own)
        exact = np.sqrt(((x[a + row] - y[col]) ** 2).sum(1))
        order = np.lexsort((others[col], exact, row))
        row, col, exact = row[order], col[order], exact[order]
        first = np.searchsorted(row, row)
        best = np.arange(len(row)) - first < k
        found.append(pd.DataFrame({"id": ids[a + row[best]], "other": others[col[best]], "d": exact[best]}))
    return pd.concat(found, ignore_index=True)


def _tree(x: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Axis and cut of each inner node of a complete tree, by levels."""
    cuts, level = [], [x]
    for _ in range(depth):
        below = []
        for part in level:
            axis = int(part.var(axis=0).argmax()) if len(part) else 0
            cut = float(np.median(part[:, axis])) if len(part) else 0.0
            cuts.append((axis, cut))
            below += [part[part[:, axis] < cut], part[part[:, axis] >= cut]]
        level = below
    return cuts


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    """A column of arrays of one length as rows of a matrix."""
    flat = table.column(column).combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _boxes(bounds: DataFrame, turn: np.ndarray) -> DataFrame:
    """(node, lo, hi, far): bounding box of each block along the turned axes, and the farthest k-th neighbour so far of its rows."""

    def box(rows: pa.Table) -> pa.Table:
        z = _matrix(rows, "x") @ turn
        far = np.array([rows.column("far").to_numpy().max()])
        return pa.table([rows.column("block").slice(0, 1), pa.array([z.min(axis=0).tolist()]), pa.array([z.max(axis=0).tolist()]), pa.array(far)], ["node", "lo", "hi", "far"])

    return bounds.select("block", "x", "far").groupBy("block").applyInArrow(box, _BOX)


def _parents(boxes: DataFrame, fan: int) -> DataFrame:
    """Boxes around ``fan`` consecutive nodes."""

    def cover(rows: pa.Table) -> pa.Table:
        lo, hi, far = _matrix(rows, "lo").min(axis=0), _matrix(rows, "hi").max(axis=0), rows.column("far").to_numpy().max()
        return pa.table([rows.column("parent").slice(0, 1), pa.array([lo.tolist()]), pa.array([hi.tolist()]), pa.array([far])], ["node", "lo", "hi", "far"])

    return boxes.withColumn("parent", F.floor(F.col("node") / fan)).groupBy("parent").applyInArrow(cover, _BOX)


def _meeting_groups(boxes: DataFrame, blocks: int, fan: int) -> DataFrame:
    """(a, b): groups of ``fan`` blocks of which b may hold neighbours of rows in a.

    Boxes form a tree, and pairs descend it from the root by equality joins on
    the parents; a pair whose boxes are farther apart than what the left one's rows look for goes no further.
    """
    levels = [written_table(_parents(boxes, fan), "neighbour-boxes")]
    nodes = -(-blocks // fan)
    while nodes > 1:
        levels.append(written_table(_parents(levels[-1], _FAN), "neighbour-boxes"))
        nodes = -(-nodes // _FAN)
    pairs = levels.pop().select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels):

        def side(name: str, level: DataFrame = level) -> DataFrame:
            return level.select(F.floor(F.col("node") / _FAN).alias(name), *[F.col(c).alias(f"{name}_{c}") for c in level.columns])

        met = pairs.join(side("a"), "a").join(side("b"), "b")
        below = F.zip_with(F.zip_with("b_lo", "a_hi", lambda x, y: x - y), F.zip_with("a_lo", "b_hi", lambda x, y: x - y), lambda x, y: F.greatest(x, y))
        gap = F.aggregate(below, F.lit(0.0), lambda total, x: total + F.greatest(x, F.lit(0.0)) * F.greatest(x, F.lit(0.0)))
        size = F.greatest(F.array_max("a_hi"), -F.array_min("a_lo"), F.array_max("b_hi"), -F.array_min("b_lo"))
        met = met.filter(F.sqrt(gap) <= F.col("a_far") * (1 + 1e-9) + 1e-9 * size)
        pairs = met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    return pairs


def _search(left: pa.Table, right: pa.Table, turn: np.ndarray, k: int) -> pa.Table:
    """The ``k`` nearest of ``right`` for each row of ``left`` within its bound ``far``, blocks of its own left out.

    Blocks come in order of distance; whatever is found tightens the bounds of the rows.
    """
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    x, y = _matrix(left, "x"), _matrix(right, "x2")
    ids, others = left.column("id").to_numpy(), right.column("id2").to_numpy()
    bounds, own, there = left.column("far").to_numpy(), left.column("block").to_numpy(), right.column("block2").to_numpy()
    names = np.unique(there)
    members = [np.flatnonzero(there == n) for n in names]
    turned = [y[m] @ turn for m in members]
    lo, hi = np.array([z.min(axis=0) for z in turned]), np.array([z.max(axis=0) for z in turned])
    slack = 1e-9 * max(np.abs(lo).max(), np.abs(hi).max())
    for name in np.unique(own):
        mine = np.flatnonzero(own == name)
        for a in range(0, len(mine), _ROWS):
            row = mine[a : a + _ROWS]
            far, z = bounds[row].copy(), x[row] @ turn
            near = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
            apart = np.maximum(np.maximum(lo - z.max(axis=0), z.min(axis=0) - hi), 0.0)
            for i in np.argsort((apart**2).sum(axis=1)):
                if names[i] == name:
                    continue
                gap = np.maximum(np.maximum(lo[i] - z, z - hi[i]), 0.0)
                some = np.flatnonzero(np.sqrt((gap**2).sum(axis=1)) <= far * (1 + 1e-9) + slack)
                if not len(some):
                    continue
                target = y[members[i]]
                centre = target.mean(axis=0)
                p, q = x[row[some]] - centre, target - centre
                q2 = (q**2).sum(axis=1)
                p2 = (p**2).sum(axis=1)
                # the fast formula only preselects, with room for its rounding; exact distances decide
                limit = far[some] ** 2 * (1 + 1e-9) + 1e-10 * (p2 + q2.max()) - p2
                r, c = np.nonzero(q2 - 2.0 * p @ q.T <= limit[:, None])
                exact = np.sqrt(((x[row[some[r]]] - target[c]) ** 2).sum(axis=1))
                hit = exact <= far[some[r]]
                if not hit.any():
                    continue
                r, d, o = np.r_[near[0], some[r[hit]]], np.r_[near[1], exact[hit]], np.r_[near[2], others[members[i]][c[hit]]]
                order = np.lexsort((o, d, r))
                r, d, o = r[order], d[order], o[order]
                rank = np.arange(len(r)) - np.searchsorted(r, r)
                best = rank < k
                last = rank == k - 1
                far[r[last]] = np.minimum(far[r[last]], d[last])
                near = r[best], d[best], o[best]
            out.append((ids[row[near[0]]], near[2], near[1]))
    found = [np.concatenate(v) for v in zip(*out)]
    return pa.table([pa.array(v) for v in found], ["id", "other", "d"])


def _distinct_nearest(points: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(id, other, d) with the ``k`` nearest of each row, for points of which no two are equal."""
    sample = [r["x"] for r in points.orderBy(F.xxhash64("id"), "id").select("x").limit(_SAMPLE).collect()]
    sample = np.array(sample, float).reshape(len(sample), -1)
    if not sample.size:
        return points.sparkSession.createDataFrame([], CANDIDATES)
    turn = np.linalg.eigh(np.cov(sample, rowvar=False).reshape(sample.shape[1], -1))[1][:, ::-1] if len(sample) > 1 else np.eye(sample.shape[1])
    blocks_wanted = min(points.count() / block_rows, len(sample) / _LEAF_SAMPLE)
    depth = max(0, int(np.ceil(np.log2(max(blocks_wanted, 1)))))
    axes, cuts = (np.array(v) for v in zip(*_tree(sample @ turn, depth))) if depth else (np.zeros(0, int), np.zeros(0))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            z = np.stack(b["x"].to_numpy()) @ turn
            node = np.zeros(len(b), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (z[np.arange(len(b)), axes[node]] >= cuts[node])
            yield b.assign(leaf=node - (2**depth - 1), p=z[:, 0])

    schema = points.select("id", "x").schema.add("leaf", "long").add("p", "double")
    placed = global_positions(points.select("id", "x").mapInPandas(place, schema), ["leaf", "p", "id"])
    # there are no more leaves than sampled rows, so one task orders them
    leaves = placed.groupBy("leaf").agg(F.min("position").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    leaves = leaves.withColumn("_parts", F.ceil(F.col("_rows") / block_rows))
    earlier = F.sum("_parts").over(W.orderBy("leaf").rowsBetween(W.unboundedPreceding, -1))
    leaves = settled(leaves.withColumn("_earlier", F.coalesce(earlier, F.lit(0))), "leaves")
    count = leaves.agg(F.sum("_parts")).first()[0]
    part = F.floor((F.col("position") - F.col("_first")) * F.col("_parts") / F.col("_rows"))
    cut = placed.join(leaves, "leaf")
    blocks = written_table(cut.select((F.col("_earlier") + part).cast("long").alias("block"), "id", "x"), "blocks")

    def inside(b: pa.Table) -> pa.Table:
        x, ids = _matrix(b, "x"), b.column("id").to_numpy()
        return pa.Table.from_pandas(_top(ids, x, ids, x, k), preserve_index=False)

    own = written_table(blocks.groupBy("block").applyInArrow(inside, CANDIDATES), "inside")
    if count == 1:
        return own
    kth = own.groupBy("id").agg(F.max("d").alias("far"), F.count(F.lit(1)).alias("found"))
    # fewer than k found means the block is too small to bound anything
    far = F.when(F.col("found") >= k, F.col("far")).otherwise(F.lit(float("inf")))
    bounded = written_table(blocks.join(kth, "id", "left").select("block", "id", "x", far.alias("far")), "bounded")
    fan = min(_FAN, -(-count // _GROUPS))
    pairs = settled(_meeting_groups(_boxes(bounded, turn), count, fan), "meetings")
    group = F.floor(F.col("block") / fan)
    left = bounded.withColumn("a", group).join(pairs, "a")
    # all columns renamed: Spark would take them for the left side's otherwise
    there = blocks.select(group.alias("b2"), F.col("block").alias("block2"), F.col("id").alias("id2"), F.col("x").alias("x2"))
    right = there.join(pairs.select(F.col("a").alias("a2"), F.col("b").alias("b2")), "b2")

    def across(a: pa.Table, b: pa.Table) -> pa.Table:
        return _search(a, b, turn, k)

    other = left.groupBy("a", "b").cogroup(right.groupBy("a2", "b2")).applyInArrow(across, CANDIDATES)
    order = W.partitionBy("id").orderBy("d", "other")
    return own.unionByName(other).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).drop("_n")


def nearest(points: DataFrame, k: int, block_rows: int = 2048) -> DataFrame:
    """(id, other, d, position) of the ``k`` nearest other rows, of all where there are fewer; the least id on ties.

    ``points`` holds id, unique, and array ``x``. The same for any partitioning.
    """
    same = written_table(points.groupBy("x").agg(F.min("id").alias("id")), "distinct-points")
    near = _distinct_nearest(same, k, block_rows)
    members = points.select("id", "x").join(same.select(F.col("id").alias("point"), "x"), "x").select("id", "point")
    # of equal points k + 1 are enough: one may be the row itself
    least = W.partitionBy("point").orderBy("id")
    firsts = written_table(members.withColumn("_n", F.row_number().over(least)).filter(F.col("_n") <= k + 1).drop("_n"), "equal-points")
    there = firsts.select(F.col("point").alias("_there"), F.col("id").alias("other"))
    met = near.withColumnRenamed("id", "point").withColumnRenamed("other", "_there").join(there, "_there").select("point", "other", "d")
    met = met.unionByName(firsts.select("point", F.col("id").alias("other"), F.lit(0.0).alias("d")))
    # k near points of k + 1 ids each, and its own
    listed = met.groupBy("point").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "other"))), 1, k + 1).alias("_near"))
    others = F.slice(F.filter("_near", lambda s: s["other"] != F.col("id")), 1, k)
    each = members.join(listed, "point").select("id", F.posexplode(others).alias("_at", "_s"))
    return each.select("id", F.col("_s.other").alias("other"), F.col("_s.d").alias("d"), (F.col("_at") + 1).alias("position"))


def near_neighbours(points: DataFrame, k: int) -> DataFrame:
    """The same as ``nearest``: all of them, none lost to density or to the edges of partitions."""
    return nearest(points, k)
