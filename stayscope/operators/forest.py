"""Random forest for classification whose trees stay with the workers.

Values are placed among at most 31 cuts per feature, by Spark ML's rule for them over 10,000 evenly
spaced values of all rows. A tree depends on a row only through these places, so rows alike in them are one
*cell* with a count per class. Each tree draws Poisson weights; those of equal rows add up, so the weight of a cell is
Poisson with its count as mean. A node tries a random choice of features; gini, and siblings that predict the same
class are joined in the end, as in Spark ML.

Weights and choices are hashes of seed, tree, cell and node: the forest depends on the rows, the cuts and the seed,
not on where cells lie. Nodes of more than ``_LOCAL`` cells are split over sums of all tasks, a level of all trees per round.
Below, one task grows a node down to its leaves. The driver holds the nodes of the first kind alone; the others are a table, to which cells are dealt
again for predictions. What travels are packed blocks of cells, once per group of ``_TREES`` whole trees or once per tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayscope.session import written_table

#: Cells from which one task grows a node, cells of a packed row, and whole trees that a task grows from the same cells
_LOCAL = 1 << 19
_BLOCK = 1 << 15
_TREES = 4
_BINS = 32
_SUMMARY = 10_000
_PLACES = 0xFFFFFFFF
_BLOCKS = "block long, n int, cells binary, counts binary"
_PARTS = "unit int, tree int, node long, feature binary, cut binary, left binary, probs binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _step(h: np.ndarray, x: np.ndarray | int) -> np.ndarray:
    """Hash of a hash and one more number."""
    return _mix(np.atleast_1d(h) + (np.atleast_1d(x).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(4096)
def _poisson(mean: int) -> tuple[int, np.ndarray]:
    """Least value and cumulative probabilities from there on; what is cut off has no place in a double."""
    wide = 12 * math.sqrt(mean) + 20
    low, high = max(0, int(mean - wide)), int(mean + wide)
    logs = math.lgamma(low + 1) + np.r_[0.0, np.cumsum(np.log(np.arange(low + 1, high + 1)))]
    return low, np.cumsum(np.exp(np.arange(low, high + 1) * math.log(mean) - mean - logs))


class _Draws:
    """Weights of cells in a tree."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray, seed: int):
        words = np.zeros((len(cells), -(-cells.shape[1] // 8) * 8), np.uint8)
        words[:, : cells.shape[1]] = cells
        self.counts, h = counts, np.full(len(cells), seed % (1 << 64), np.uint64)
        for word in np.ascontiguousarray(words).view("<u8").T:
            h = _step(h, word)
        self.drawn = []
        for c in range(counts.shape[1]):
            order = np.argsort(counts[:, c], kind="stable")
            order = order[counts[order, c] > 0]
            means, starts = np.unique(counts[order, c], return_index=True)
            self.drawn.append((_step(h[order], c), [(at, *_poisson(int(m))) for m, at in zip(means, np.split(order, starts[1:]))], starts))

    def of(self, tree: int) -> np.ndarray:
        out = np.zeros(self.counts.shape)
        for c, (h, groups, starts) in enumerate(self.drawn):
            u = (_step(h, tree) >> np.uint64(11)) * 2.0**-53
            for (at, low, cdf), part in zip(groups, np.split(u, starts[1:])):
                out[at, c] = low + np.minimum(np.searchsorted(cdf, part, "right"), len(cdf) - 1)
        return out


def _choice(seed: int, tree: int, ids: np.ndarray, d: int, q: int) -> np.ndarray:
    """``q`` of ``d`` features for each node."""
    h = _step(_step(np.full(len(ids), (seed + 1) % (1 << 64), np.uint64), tree), ids)
    return np.argsort(_step(h[:, None], np.arange(d)), axis=1, kind="stable")[:, :q]


def _gini(counts: np.ndarray) -> np.ndarray:
    """Of counts by class, along the last axis."""
    n = counts.sum(-1)
    return 1.0 - ((counts / np.maximum(n, 1.0)[..., None]) ** 2).sum(-1)


def _gain(total: np.ndarray, left: np.ndarray) -> np.ndarray:
    right = total - left
    n, a, b = total.sum(-1), left.sum(-1), right.sum(-1)
    return np.where((a > 0) & (b > 0), _gini(total) - a / n * _gini(left) - b / n * _gini(right), -1.0)


def _histograms(places: np.ndarray, w: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
    """(node, place, class): weight; ``places`` are those of the feature that the row's node tries."""
    key = slot * _BINS + places
    return np.stack([np.bincount(key, w[:, c], n * _BINS) for c in range(w.shape[1])], -1).reshape(n, _BINS, -1)


def _best_by_sums(total: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gain and place of each node's best cut, the first of equal ones."""
    gain = _gain(total[:, None], np.cumsum(sums, axis=1)[:, :-1])
    at = gain.argmax(1)
    return gain[np.arange(len(at)), at], at


def _best_by_order(places: np.ndarray, w: np.ndarray, slot: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for many small nodes: rows in order of node and place."""
    out, cut = np.full(len(total), -1.0), np.zeros(len(total), np.int64)
    key = np.sort((slot << 8 | places) << 32 | np.arange(len(slot)))
    run = key >> 32
    ends = np.flatnonzero(run[1:] != run[:-1])
    ends = ends[run[ends] >> 8 == run[ends + 1] >> 8]
    if len(ends):
        s = run[ends] >> 8
        left = np.cumsum(w[key & _PLACES], axis=0)[ends] - (np.cumsum(total, axis=0) - total)[s]
        gain = _gain(total[s], left)
        starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        best = np.maximum.reduceat(gain, starts)
        at = np.flatnonzero(gain == np.repeat(best, np.diff(np.r_[starts, len(s)])))
        first = at[np.searchsorted(at, starts)]
        out[s[starts]], cut[s[starts]] = best, run[ends[first]] & 255
    return out, cut


def _grow(cells: np.ndarray, w: np.ndarray, tree: int, root: int, seed: int, q: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature (-1 at leaves), cut, left child (the right one follows; at leaves the number of the leaf) and probabilities of the leaves, below a node."""
    d = cells.shape[1]
    rows = np.flatnonzero(w.any(axis=1))
    cells, w, slot = cells[rows], w[rows], np.zeros(len(rows), np.int64)
    ids, level, levels, made = np.array([root]), root.bit_length() - 1, [], 0
    while len(ids):
        n = len(ids)
        count = np.stack([np.bincount(slot, w[:, c], n) for c in range(w.shape[1])], -1)
        feature, cut, left = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        made += n
        mixed = np.flatnonzero((count > 0).sum(1) > 1) if level < depth else np.zeros(0, np.int64)
        if len(mixed):
            to = np.full(n, -1)
            to[mixed] = np.arange(len(mixed))
            kept = np.flatnonzero(to[slot] >= 0)
            cells, w, slot = cells[kept], w[kept], to[slot[kept]]
            total, tried = count[mixed], _choice(seed, tree, ids[mixed], d, q)
            best, f_best, c_best = np.zeros(len(mixed)), np.full(len(mixed), -1), np.zeros(len(mixed), np.int64)
            base = np.arange(len(cells)) * d
            for j in range(q):
                places = cells.ravel()[base + tried[slot, j]].astype(np.int64)
                if len(mixed) * _BINS <= 2 * len(slot):
                    gain, at = _best_by_sums(total, _histograms(places, w, slot, len(mixed)))
                else:
                    gain, at = _best_by_order(places, w, slot, total)
                better = gain > best
                best[better], f_best[better], c_best[better] = gain[better], tried[better, j], at[better]
            split = np.flatnonzero(f_best >= 0)
            feature[mixed], cut[mixed] = f_best, c_best
            left[mixed[split]] = made + 2 * np.arange(len(split))
            to = np.full(len(mixed), -1)
            to[split] = np.arange(len(split))
            kept = np.flatnonzero(to[slot] >= 0)
            cells, w, slot = cells[kept], w[kept], slot[kept]
            right = cells.ravel()[np.arange(len(cells)) * d + f_best[slot]] > c_best[slot]
            slot = 2 * to[slot] + right
            below = ids[mixed[split]]
            ids = np.stack([2 * below, 2 * below + 1], 1).ravel()
        else:
            ids = np.zeros(0, np.int64)
        levels.append((feature, cut, left, count))
        level += 1
    ends = np.cumsum([0, *(len(x[0]) for x in levels)])
    feature, cut, left, count = (np.concatenate(x) for x in zip(*levels))
    _join_alike(feature, left, count, ends)
    return _reached(feature, cut, left, count, ends)


def _join_alike(feature: np.ndarray, left: np.ndarray, count: np.ndarray, ends: np.ndarray) -> None:
    """Leaves of one parent that predict the same class become one, from the deepest on."""
    says = count.argmax(1)
    for a, b in zip(ends[-2::-1], ends[:0:-1]):
        inner = a + np.flatnonzero(feature[a:b] >= 0)
        child = left[inner]
        alike = (feature[child] < 0) & (feature[child + 1] < 0) & (says[child] == says[child + 1])
        feature[inner[alike]] = -1


def _reached(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, count: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nodes that are left, numbered anew."""
    kept = np.zeros(len(feature), bool)
    kept[0] = True
    for a, b in zip(ends[:-1], ends[1:]):
        child = left[a + np.flatnonzero(kept[a:b] & (feature[a:b] >= 0))]
        kept[child] = kept[child + 1] = True
    place = np.cumsum(kept) - 1
    leaf = feature < 0
    left = np.where(leaf, np.cumsum(kept & leaf) - 1, place[np.where(leaf, 0, left)])[kept]
    ended = count[kept & leaf]
    return feature[kept].astype("<i2"), cut[kept].astype("u1"), left.astype("<i4"), ended / ended.sum(1, keepdims=True)


def _descend(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The node without a cut at which each cell ends."""
    at, d = np.zeros(len(cells), np.int64), cells.shape[1]
    flat, rows = cells.ravel(), np.flatnonzero(np.full(len(cells), feature[0] >= 0))
    while len(rows):
        here = at[rows]
        here = left[here] + (flat[rows * d + feature[here]] > cut[here])
        at[rows] = here
        rows = rows[feature[here] >= 0]
    return at


class _Top:
    """The nodes of a tree that many tasks split together; ``state`` is -1 at a node whose children follow, -2 at a leaf, -3 while it is open, else the unit that grows it."""

    def __init__(self, count: np.ndarray, state: int):
        self.id, self.feature, self.cut, self.left, self.count, self.state = [1], [-1], [0], [0], [np.asarray(count, float)], [state]

    def split(self, k: int, feature: int, cut: int, children: Sequence[tuple[np.ndarray, int]]) -> None:
        self.feature[k], self.cut[k], self.left[k], self.state[k] = feature, cut, len(self.id), -1
        for side, (count, state) in enumerate(children):
            for column, value in ((self.id, 2 * self.id[k] + side), (self.feature, -1), (self.cut, 0), (self.left, 0), (self.count, count), (self.state, state)):
                column.append(value)

    def join_alike(self, leaves: dict[int, bool]) -> None:
        """As in a part; ``leaves`` has the units that turned out to be a leaf."""
        ended = [s == -2 or (s >= 0 and leaves.get(s, False)) for s in self.state]
        for k in reversed(range(len(self.id))):
            if self.state[k] == -1:
                a, b = self.left[k], self.left[k] + 1
                if ended[a] and ended[b] and np.argmax(self.count[a]) == np.argmax(self.count[b]):
                    self.feature[k], self.state[k], ended[k] = -1, -2, True

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature), np.array(self.cut), np.array(self.left)

    def known(self) -> dict:
        return {"id": self.id, "feature": self.feature, "cut": self.cut, "left": self.left, "count": [c.tolist() for c in self.count], "state": self.state}

    @staticmethod
    def of(known: dict) -> _Top:
        top = _Top(np.zeros(1), -2)
        for name, values in known.items():
            setattr(top, name, [np.array(v) for v in values] if name == "count" else list(values))
        return top


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs."""
    top = int(x.max(initial=0))
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64)


def _block(r: dict, d: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(r["cells"], np.uint8).reshape(r["n"], d), _unpacked(r["counts"], r["n"] * classes).reshape(r["n"], classes)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _cell(cuts: Sequence[np.ndarray], cols: Sequence[str]) -> Column:
    """Place of each value among the cuts, a byte per feature; gaps and NaN come after all cuts."""

    @F.arrow_udf("binary")
    def place(*values: pa.Array) -> pa.Array:
        n, d = len(values[0]), len(cuts)
        out = np.empty((n, d), np.uint8)
        for j, (v, c) in enumerate(zip(values, cuts)):
            out[:, j] = np.searchsorted(c, v.to_numpy(zero_copy_only=False))
        ends = np.arange(0, (n + 1) * d, d, dtype=np.int32)
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(out)])

    return place(*[F.col(f"`{c}`").cast("double") for c in cols])


def _cuts(values: Sequence[float]) -> np.ndarray:
    """Spark ML's rule: middles between neighbours; of many values, where the count passes a multiple of its 32nd part."""
    v, n = np.unique(np.asarray(values, float), return_counts=True)
    middle = (v[:-1] + v[1:]) / 2
    if len(middle) < _BINS:
        return middle
    stride, before, out = n.sum() / _BINS, np.cumsum(n), []
    wanted = stride
    for i in range(len(middle)):
        if abs(before[i] - wanted) < abs(before[i + 1] - wanted):
            out.append(middle[i])
            wanted += stride
    return np.array(out[: _BINS - 1])


def _pack(cells: DataFrame, d: int, classes: int) -> DataFrame:
    """Blocks of (cell, counts)."""
    schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, found, held, n = TaskContext.get().partitionId() << 32, [], [], 0

        def out() -> pa.RecordBatch:
            nonlocal first, found, held, n
            row = {"block": first, "n": n, "cells": b"".join(found), "counts": _packed(np.concatenate(held))}
            first, found, held, n = first + 1, [], [], 0
            return _table([row], schema)

        for b in batches:
            for a in range(0, b.num_rows, _BLOCK):
                part = b.slice(a, _BLOCK)
                if n and n + part.num_rows > _BLOCK:
                    yield out()
                found.append(b"".join(part.column(0).to_pylist()))
                held.append(np.stack([part.column(c + 1).to_numpy() for c in range(classes)], -1).ravel())
                n += part.num_rows
        if n:
            yield out()

    return cells.mapInArrow(pack, _BLOCKS)


def _split_together(blocks: DataFrame, tops: list[_Top], open_: list[list[int]], d: int, classes: int, seed: int, q: int) -> list:
    """(tree, node, gain, feature, cut, left, right) of each open node's best split; counts have the number of cells at the end."""
    arrays = [t.arrays() for t in tops]
    ids = [np.array([t.id[k] for k in o], np.int64) for t, o in zip(tops, open_)]
    schema = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("sums", pa.binary())])
    shape = (q, _BINS, classes + 1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(o), *shape)) for o in open_]
        for r in _rows(batches):
            cells, counts = _block(r, d, classes)
            draws = _Draws(cells, counts, seed)
            for tree, o in enumerate(open_):
                if not o:
                    continue
                to = np.full(len(arrays[tree][0]), -1)
                to[o] = np.arange(len(o))
                w = draws.of(tree)
                slot = to[_descend(*arrays[tree], cells)]
                rows = np.flatnonzero((slot >= 0) & w.any(axis=1))
                w, slot = np.c_[w[rows], np.ones(len(rows))], slot[rows]
                tried = _choice(seed, tree, ids[tree], d, q)
                for j in range(q):
                    sums[tree][:, j] += _histograms(cells[rows, tried[slot, j]].astype(np.int64), w, slot, len(o))
        for tree, s in enumerate(sums):
            if len(s):
                yield _table([{"tree": tree, "node": i, "sums": x.tobytes()} for i, x in enumerate(s)], schema)

    def best(rows: pa.Table) -> pa.Table:
        tree, node = rows.column("tree")[0].as_py(), rows.column("node")[0].as_py()
        sums = np.sum([np.frombuffer(x.as_py()).reshape(shape) for x in rows.column("sums")], axis=0)
        total, out = sums[0].sum(axis=0), (0.0, -1, 0, np.zeros(classes + 1))
        tried = _choice(seed, tree, ids[tree][node : node + 1], d, q)[0]
        for j in range(q):
            gain, at = _best_by_sums(total[None, :classes], sums[j][None, :, :classes])
            if gain[0] > out[0]:
                out = (float(gain[0]), int(tried[j]), int(at[0]), sums[j][: at[0] + 1].sum(axis=0))
        return pa.table([[tree], [node], [out[0]], [out[1]], [out[2]], [out[3].tolist()], [(total - out[3]).tolist()]], ["tree", "node", "gain", "feature", "cut", "left", "right"])

    added = blocks.mapInArrow(add, "tree int, node int, sums binary")
    return added.groupBy("tree", "node").applyInArrow(best, "tree long, node long, gain double, feature long, cut long, left array<double>, right array<double>").collect()


def _dealt(blocks: DataFrame, tops: list[_Top] | None, units: Sequence[Sequence[tuple[int, int]]], d: int, classes: int) -> DataFrame:
    """(unit, block, n, cells, counts, place): the cells that each unit needs, with their places in the block."""
    arrays = [(*t.arrays(), np.array(t.state)) for t in tops] if tops else []
    schema = pa.schema([("unit", pa.int32()), ("block", pa.int64()), ("n", pa.int32()), ("cells", pa.binary()), ("counts", pa.binary()), ("place", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            if not arrays:
                for u in range(len(units)):
                    yield _table([{"unit": u, "place": None, **r}], schema)
                continue
            cells, counts = _block(r, d, classes)
            for feature, cut, left, state in arrays:
                unit = state[_descend(feature, cut, left, cells)]
                order = np.argsort(unit, kind="stable")
                values, starts = np.unique(unit[order], return_index=True)
                found = [(int(u), at) for u, at in zip(values, np.split(order, starts[1:])) if u >= 0]
                if found:
                    yield _table(
                        [{"unit": u, "block": r["block"], "n": len(at), "cells": cells[at].tobytes(), "counts": _packed(counts[at].ravel()), "place": at.astype("<u4").tobytes()} for u, at in found], schema
                    )

    # one task per unit, as their rows are few and their work is large
    return blocks.mapInArrow(deal, "unit int, block long, n int, cells binary, counts binary, place binary").repartition(_tasks(units), "unit")


def _tasks(units: Sequence) -> int:
    return min(4 * len(units) + 1, 2000)


def fit(train: DataFrame, cols: Sequence[str], label: str, trees: int, depth: int, seed: int) -> Forest:
    """Runs at once."""
    d, q, y = len(cols), math.ceil(math.sqrt(len(cols))), F.col(label).cast("double")
    points = F.split(F.lit(",".join(str((i + 0.5) / _SUMMARY) for i in range(_SUMMARY))), ",").cast("array<double>")
    known = train.agg(
        F.count(F.lit(1)).alias("n"), F.max(y).alias("top"), F.min(y.isNotNull() & (y >= 0) & (y == F.floor(y))).alias("fit"),
        F.array(*[F.percentile_approx(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), points, 4 * _SUMMARY) for c in cols]).alias("values"),
    ).first()
    if not known["n"] or not known["fit"] or known["top"] >= 100:
        raise ValueError(f"labels in {label} have to be whole numbers from 0 to 99, of one row at least")
    classes, cuts = max(int(known["top"]), 1) + 1, [_cuts(v or []) for v in known["values"]]
    counted = train.select(_cell(cuts, cols).alias("cell"), y.cast("int").alias("y")).groupBy("cell").agg(*[F.count(F.when(F.col("y") == c, 1)).alias(f"n{c}") for c in range(classes)])
    blocks = written_table(_pack(counted, d, classes), "forest-cells")
    size = blocks.agg(F.sum("n")).first()[0]

    # a unit is what one task grows from the same cells
    tops, units = None, [[(t, 1) for t in range(a, min(a + _TREES, trees))] for a in range(0, trees, _TREES)]
    if size > _LOCAL:
        units, tops = [], [_Top(np.zeros(classes), -3) for _ in range(trees)]

        def state(tree: int, node: int, count: np.ndarray) -> tuple[np.ndarray, int]:
            count, n = np.array(count[:-1]), count[-1]
            if (count > 0).sum() < 2 or node.bit_length() - 1 >= depth:
                return count, -2
            if n > _LOCAL:
                return count, -3
            units.append([(tree, node)])
            return count, len(units) - 1

        while any(open_ := [[k for k, s in enumerate(t.state) if s == -3] for t in tops]):
            for r in sorted(_split_together(blocks, tops, open_, d, classes, seed, q), key=lambda r: (r["tree"], r["node"])):
                top, k = tops[r["tree"]], open_[r["tree"]][r["node"]]
                if not k:
                    top.count[0] = np.array(r["left"][:-1]) + np.array(r["right"][:-1])
                if r["feature"] < 0:
                    top.state[k] = -2
                else:
                    top.split(k, r["feature"], r["cut"], [state(r["tree"], 2 * top.id[k] + side, r[name]) for side, name in enumerate(("left", "right"))])

    schema = pa.schema([("unit", pa.int32()), ("tree", pa.int32()), ("node", pa.int64()), *((c, pa.binary()) for c in ("feature", "cut", "left", "probs"))])

    def grow(rows: pa.Table) -> pa.Table:
        unit = rows.column("unit")[0].as_py()
        cells, counts = (np.concatenate(x) for x in zip(*[_block(r, d, classes) for r in _rows(rows.to_batches())]))
        draws, out = _Draws(cells, counts, seed), []
        for tree, node in units[unit]:
            made = _grow(cells, draws.of(tree), tree, node, seed, q, depth)
            out.append({"unit": unit, "tree": tree, "node": node, **{c: x.tobytes() for c, x in zip(("feature", "cut", "left", "probs"), made)}})
        return pa.Table.from_pylist(out, schema=schema)

    parts = written_table(_dealt(blocks, tops, units, d, classes).groupBy("unit").applyInArrow(grow, _PARTS), "forest")
    if tops:
        leaves = {r["unit"]: r["leaf"] for r in parts.select("unit", (F.octet_length("cut") == 1).alias("leaf")).collect()}
        for t in tops:
            t.join_alike(leaves)
    return Forest(list(cols), cuts, classes, trees, units, tops, parts)


class Forest(Model, MLWritable, MLReadable):
    """A fitted forest. ``transform`` places the rows, sends each distinct cell through all trees at once, and joins the sums lazily."""

    def __init__(self, cols: list[str], cuts: list[np.ndarray], classes: int, trees: int, units: list, tops: list[_Top] | None, parts: DataFrame):
        super().__init__()
        self.cols, self.cuts, self.classes, self.trees, self.units, self.tops, self.parts = cols, cuts, classes, trees, units, tops, parts

    def _votes(self, cells: DataFrame) -> DataFrame:
        """(cell, raw): the trees' probabilities of each class added up."""
        d, classes, trees, tops = len(self.cols), self.classes, self.trees, self.tops
        blocks = written_table(_pack(cells.distinct().withColumn("n", F.lit(1)), d, 1), "forest-asked")
        dealt = _dealt(blocks, tops, self.units, d, 1)
        schema = pa.schema([("block", pa.int64()), ("place", pa.binary()), ("votes", pa.binary())])

        def vote(asked: pa.Table, parts: pa.Table) -> pa.Table:
            grown = []
            for r in _rows(parts.to_batches()):
                probs = np.frombuffer(r["probs"]).reshape(-1, classes)[:, 1:]
                grown.append((np.frombuffer(r["feature"], "<i2"), np.frombuffer(r["cut"], "u1"), np.frombuffer(r["left"], "<i4"), probs))
            out = []
            for r in _rows(asked.to_batches()):
                cells, _ = _block(r, d, 1)
                votes = sum(probs[left[_descend(feature, cut, left, cells)]] for feature, cut, left, probs in grown)
                out.append({"block": r["block"], "place": r["place"], "votes": votes.tobytes()})
            return pa.Table.from_pylist(out, schema=schema)

        ended = [(*t.arrays(), np.array(t.state) == -2, np.array(t.count)) for t in tops] if tops else []

        def add(block: pa.Table, votes: pa.Table) -> pa.Table:
            r = next(_rows(block.to_batches()))
            cells, _ = _block(r, d, 1)
            total = np.zeros((r["n"], classes))
            for v in sorted(_rows(votes.to_batches()), key=lambda v: v["unit"]):
                some = np.frombuffer(v["votes"]).reshape(-1, classes - 1)
                at = slice(None) if v["place"] is None else np.frombuffer(v["place"], "<u4")
                total[at, 1:] += some
            for feature, cut, left, leaf, count in ended:
                at = _descend(feature, cut, left, cells)
                rows = np.flatnonzero(leaf[at])
                total[rows, 1:] += (count[at[rows]] / count[at[rows]].sum(1, keepdims=True))[:, 1:]
            total[:, 0] = np.maximum(trees - total[:, 1:].sum(1), 0.0)
            raw = pa.ListArray.from_arrays(np.arange(0, total.size + 1, classes, dtype=np.int32), total.ravel())
            return pa.table([pa.array([x.tobytes() for x in cells]), raw], ["cell", "raw"])

        voted = dealt.groupBy("unit").cogroup(self.parts.repartition(_tasks(self.units), "unit").groupBy("unit")).applyInArrow(
            _with_unit(vote), "unit int, block long, place binary, votes binary"
        )
        return written_table(blocks.groupBy("block").cogroup(voted.groupBy("block")).applyInArrow(add, "cell binary, raw array<double>"), "forest-votes")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cell = _cell(self.cuts, self.cols)
        votes = self._votes(dataset.select(cell.alias("cell"))).withColumnsRenamed({"cell": "_cell", "raw": "_raw"})
        rows = dataset.withColumn("_cell", cell).join(votes, "_cell")
        share = F.transform("_raw", lambda v: v / F.lit(float(self.trees)))
        says = (F.array_position("_raw", F.array_max("_raw")) - 1).cast("double")
        added = {"rawPrediction": array_to_vector("_raw"), "probability": array_to_vector(share), "prediction": says}
        return rows.withColumns(added).drop("_cell", "_raw")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


def _with_unit(vote):
    """Unit as first column, by which sums are added in one order."""

    def run(asked: pa.Table, parts: pa.Table) -> pa.Table:
        unit = parts.column("unit")[0].as_py() if parts.num_rows else -1
        out = vote(asked, parts)
        return out.add_column(0, "unit", pa.array([unit] * out.num_rows, pa.int32()))

    return run


class _Writer(MLWriter):
    def __init__(self, forest: Forest):
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:
        f = self.forest
        tops = [t.known() for t in f.tops] if f.tops else None
        DefaultParamsWriter.saveMetadata(
            f, path, self.sparkSession, {"forest": {"cols": f.cols, "cuts": [c.tolist() for c in f.cuts], "classes": f.classes, "trees": f.trees, "units": f.units, "tops": tops}}
        )
        f.parts.write.parquet(f"{path}/parts")


class _Reader(MLReader):
    def load(self, path: str) -> Forest:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        m = metadata["forest"]
        tops = [_Top.of(t) for t in m["tops"]] if m["tops"] else None
        forest = Forest(m["cols"], [np.array(c, float) for c in m["cuts"]], m["classes"], m["trees"], m["units"], tops, self.sparkSession.read.schema(_PARTS).parquet(f"{path}/parts"))
        forest._resetUid(metadata["uid"])
        return forest
