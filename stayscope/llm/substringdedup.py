"""Passages that an earlier document has are removed.

A suffix is a word position with ``window`` words before the end of its document.
Suffixes are grouped by a prefix that lies inside the window: the run of
``prefix`` words with the least hash (equal windows have the same one), so a
group holds few consecutive suffixes of a document together, as one stretch of
text. Groups without two documents cannot repeat and are dropped.

A group of more than ``group`` bytes of text does not fit and is dealt to parts that do,
by document. Of the stretches of equal words in a part all but those of its least
document go as a whole, then likewise of those that all parts leave. If what stays
still does not fit, its suffixes are grouped again by the next longer prefix of
``longer``, at last by the whole window, where this settles everything.

In each group that fits the suffix tree of its stretches is built: suffixes sorted
by doubling, the common words of neighbours, and the intervals of them, which are
the tree's internal nodes. A node as deep as the window is a repeat; the least
document below it keeps its words. ``maximal_repeats`` lists the deep nodes.

Defined cases: a null text has no words; documents of fewer words than the
window lose nothing; equal ids are one document and never remove from each
other; null ids neither lose words nor take them; overlapping repeats are
removed as their union, judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayscope.llm.textarrays import NOT_SPACE, firsts, joined, least_run, map_slices, mix, range_hash, sequence_hash, text_bytes, words
from stayscope.session import written_table

_SALTS = 16
_TREE_BYTES = 3 << 20


@dataclass(frozen=True)
class Repeats:
    window: int = 50
    prefix: int = 12
    longer: tuple[int, ...] = (20, 32)  # prefixes of groups that do not fit; the window comes last
    group: int = 2 << 20  # bytes of text

    @property
    def lengths(self) -> list[int]:
        return [self.prefix, *(x for x in sorted(self.longer) if self.prefix < x < self.window), self.window]


def _stretches(texts: list[bytes], size: Repeats, prefix: int):
    """Words of the texts, and for each run of suffixes with one prefix: its text, first and last suffix, and the prefix."""
    data, begin = joined(texts)
    start, end = words(data, NOT_SPACE)
    first = firsts(start, begin)
    none = np.zeros(0, np.int64)
    symbol = range_hash(data, start, end, seed=41)
    if len(symbol) < size.window:
        return data, start, end, first, none, none, none, np.zeros(0, np.uint64)
    gram = sequence_hash(symbol, prefix, seed=42)
    at = least_run(gram, size.window - prefix + 1)
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    whole = of[: len(at)] == of[size.window - 1 :]
    change = np.r_[True, (at[1:] != at[:-1]) | (of[1 : len(at)] != of[: len(at) - 1])]
    change[1:] |= whole[1:] != whole[:-1]
    run = np.flatnonzero(change)
    last = np.r_[run[1:], len(at)] - 1
    real = whole[run]
    run, last = run[real], last[real]
    return data, start, end, first, of[run], run, last, gram[at[run]]


def _prefixes(docs: DataFrame, size: Repeats) -> DataFrame:
    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        _, start, end, _, of, run, last, key = _stretches(text_bytes(part), size, size.prefix)
        long = end[last + size.window - 1] - start[run]
        return pa.record_batch([part.column("doc_id").take(pa.array(of)), pa.array(key.view(np.int64)), pa.array(long)], ["doc_id", "prefix", "long"])

    return map_slices(docs.select("doc_id", "text"), rows, "doc_id long, prefix long, long long")


def _shared(stretches: DataFrame, size: Repeats) -> DataFrame:
    """(prefix, parts) of the prefixes that two documents have: into how many parts their text has to be dealt to fit."""
    found = stretches.groupBy("prefix").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("long").alias("total"))
    return found.filter("low < high").select("prefix", F.ceil(F.col("total") / max(size.group, 1)).alias("parts"))


def _met(rows: DataFrame, few: DataFrame, on: list[str], *spread: str) -> DataFrame:
    """Rows and what ``few`` says of their key; a key of very many rows goes to as many tasks as there are salts."""
    salted = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(_SALTS)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


_STRETCH = "doc_id long, text_key long, place long, prefix long, n_words long, long long, span binary"


def _first_stretches(docs: DataFrame, size: Repeats) -> DataFrame:
    """The stretches of shared prefixes with ``parts``; where these are several, with the words one blank apart."""
    prefixes = written_table(_prefixes(docs, size), "prefixes")
    own = _met(prefixes.select("doc_id", "prefix"), _shared(prefixes, size), ["prefix"], "doc_id").distinct()
    wanted = own.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("prefix").alias("prefixes"), F.collect_list("parts").alias("dealt"))
    chosen = docs.join(wanted, docs["doc_id"] == wanted["_id"]).drop("_id")

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = text_bytes(part)
        data, start, end, first, of, run, last, key = _stretches(texts, size, size.prefix)
        key = key.view(np.int64)
        parts = np.zeros(len(key), np.int64)
        bound = np.searchsorted(of, np.arange(len(texts) + 1))
        for i, (known, dealt) in enumerate(zip(part.column("prefixes"), part.column("dealt"))):
            known, dealt = known.values.to_numpy(), dealt.values.to_numpy()
            order = np.argsort(known)
            mine = key[bound[i] : bound[i + 1]]
            at = order[np.minimum(np.searchsorted(known, mine, sorter=order), len(known) - 1)]
            parts[bound[i] : bound[i + 1]] = np.where(known[at] == mine, dealt[at], 0)
        t = np.flatnonzero(parts)
        low, high, flat = start[run[t]], end[last[t] + size.window - 1], data.tobytes()
        span = [b" ".join(flat[a:b].split()) if g else flat[a:b] for a, b, g in zip(low.tolist(), high.tolist(), (parts[t] > 1).tolist())]
        who = pa.array(of[t])
        columns = [part.column("doc_id").take(who), part.column("text_key").take(who), *(pa.array(x.astype(np.int64)) for x in (run[t] - first[of[t]], key[t], last[t] - run[t] + size.window, high - low)), pa.array(span, pa.binary()), pa.array(parts[t])]
        return pa.record_batch(columns, ["doc_id", "text_key", "place", "prefix", "n_words", "long", "span", "parts"])

    return written_table(map_slices(chosen, rows, _STRETCH + ", parts long"), "stretches")


def _by_longer(stretches: DataFrame, length: int, size: Repeats) -> DataFrame:
    """The same suffixes, grouped by prefixes of ``length`` words inside their former groups."""

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        data, start, end, first, of, run, last, key = _stretches(text_bytes(part, "span"), size, length)
        low, high, flat = start[run], end[last + size.window - 1], data.tobytes()
        who = pa.array(of)
        key = mix(key ^ part.column("prefix").to_numpy().view(np.uint64)[of])
        place = part.column("place").to_numpy()[of] + run - first[of]
        columns = [part.column("doc_id").take(who), part.column("text_key").take(who), *(pa.array(x) for x in (place, key.view(np.int64), (last - run + size.window).astype(np.int64), high - low)), pa.array([flat[a:b] for a, b in zip(low.tolist(), high.tolist())], pa.binary()), part.column("parts").take(who)]
        return pa.record_batch(columns, ["doc_id", "text_key", "place", "prefix", "n_words", "long", "span", "parts"])

    return map_slices(stretches, rows, _STRETCH + ", parts long", "span")


def _copies(stretches: DataFrame, *among: str) -> DataFrame:
    """With the least document of equal words among those equal in ``among``, and the place there; copies keep no text."""
    equal = Window.partitionBy("prefix", "name", *among)
    found = stretches.withColumns({"least": F.min("doc_id").over(equal), "least_place": F.min_by("place", "doc_id").over(equal)})
    return written_table(found.withColumn("span", F.when(F.col("least") == F.col("doc_id"), F.col("span"))), "copies")


def _grouped(docs: DataFrame, size: Repeats) -> tuple[DataFrame, DataFrame]:
    """Stretches in groups that fit a tree, and stretches of other groups whose words an earlier document has (with its id and place)."""
    found = _first_stretches(docs, size)
    columns = [c for c in found.columns if c != "parts"]
    fit, left, copies = [found.filter("parts = 1").select(columns)], found.filter("parts > 1"), []
    for length in size.lengths:
        if left.isEmpty():
            break
        if length > size.prefix:
            left = _by_longer(left, length, size)
        dealt = left.withColumns({"name": F.unhex(F.md5("span")), "part": F.pmod(F.xxhash64("doc_id"), F.col("parts"))})
        inside = _copies(dealt, "part")
        among = _copies(inside.filter("least = doc_id").drop("least", "least_place", "part"))
        copies += [x.filter("least < doc_id").select("doc_id", "text_key", "place", "n_words", "prefix", "name", "least", "least_place") for x in (inside, among)]
        if length < size.window:
            stay = among.filter("least = doc_id").select(columns)
            stay = _met(stay, _shared(stay, size), ["prefix"], "doc_id", "place")
            fit.append(stay.filter("parts = 1").select(columns))
            left = stay.filter("parts > 1")
    if not copies:
        more = {"name": F.col("span"), "least": F.col("doc_id"), "least_place": F.col("place")}
        copies.append(found.filter("false").withColumns(more).select("doc_id", "text_key", "place", "n_words", "prefix", *more))
    return reduce(DataFrame.unionByName, fit), reduce(DataFrame.unionByName, copies)


class _Tree:
    """The suffix tree of some stretches, as its suffixes in order and the words that neighbours share."""

    def __init__(self, spans: list[bytes], window: int):
        data, begin = joined(spans)
        start, end = words(data, NOT_SPACE)
        first = firsts(start, begin)
        length = np.diff(first)
        kind, code = np.unique(range_hash(data, start, end, seed=41), return_inverse=True)
        # each stretch ends in a symbol of its own, so that no node crosses its end
        node = np.insert(code.astype(np.int64), first[1:], len(kind) + np.arange(len(spans)))
        self.first = first[:-1] + np.arange(len(spans))
        of = np.repeat(np.arange(len(spans)), length + 1)
        symbol = node
        levels, reach = [node], 1
        while reach <= length.max(initial=0):
            after = np.r_[node[reach:], np.full(reach, -1)] + 1
            node = np.unique(node * np.int64(len(kind) + len(node) + 1) + after, return_inverse=True)[1].astype(np.int64)
            levels.append(node)
            reach *= 2
        inside = np.flatnonzero(np.arange(len(node)) + window <= (self.first + length)[of])
        #: places of the suffixes in order, and the stretch of each
        self.place = inside[np.argsort(node[inside], kind="stable")]
        self.owner = of[self.place]
        #: the symbol before each suffix; where its stretch begins, one like no other
        self.before = np.where(self.place > self.first[self.owner], symbol[self.place - 1], -1 - np.arange(len(self.place)))
        a, b = self.place[:-1], self.place[1:]
        #: common words of each suffix and the next
        self.common = np.zeros(len(a), np.int64)
        for step in reversed(range(len(levels))):
            x, y = a + self.common, b + self.common
            real = np.maximum(x, y) < len(node)
            same = np.flatnonzero(real)
            same = same[levels[step][x[same]] == levels[step][y[same]]]
            self.common[same] += 1 << step

    def later(self, doc: np.ndarray, window: int) -> np.ndarray:
        """Places of the suffixes below a node of ``window`` words or more that an earlier document has too."""
        if not len(self.place):
            return self.place
        cut = np.flatnonzero(np.r_[True, self.common < window])
        own = doc[self.owner]
        least = np.repeat(np.minimum.reduceat(own, cut), np.diff(np.r_[cut, len(own)]))
        return np.sort(self.place[least < own])

    def deep_nodes(self, window: int) -> Iterator[tuple[int, int, int]]:
        """(words, first and past last suffix) of every internal node of ``window`` words or more with different words before."""
        above: list[tuple[int, int]] = []
        for i, words_ in enumerate([*self.common.tolist(), 0]):
            left = i
            while above and above[-1][0] > words_:
                depth, left = above.pop()
                if (self.before[left : i + 1] != self.before[left]).any():
                    yield depth, left, i + 1
            if words_ >= window and (not above or above[-1][0] < words_):
                above.append((words_, left))


def _trees(groups: DataFrame, size: Repeats, made, schema: str) -> DataFrame:
    """``made`` (tree, doc, text_key, place of the stretches) over whole groups, a few MB of text at a time."""
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ("prefix", "doc_id", "text_key", "place")

    def run(batches):
        def done():
            doc, key, place = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
            return made(_Tree([x for h in held for x in h[4]], size.window), doc, key, place)

        held, volume, previous = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            prefix, *rest = (batch.column(c).to_numpy() for c in columns)
            spans = batch.column("span").to_pylist()
            cut = [0, *(np.flatnonzero(prefix[1:] != prefix[:-1]) + 1).tolist(), len(prefix)]
            for i, j in zip(cut[:-1], cut[1:]):
                if held and prefix[i] != previous and volume > _TREE_BYTES:
                    yield done()
                    held, volume = [], 0
                held.append((prefix[i:j], *(c[i:j] for c in rest), spans[i:j]))
                volume += sum(map(len, spans[i:j]))
                previous = prefix[i]
        if held:
            yield done()

    return groups.select(*columns, "span").repartition(parts, "prefix").sortWithinPartitions("prefix").mapInArrow(run, schema)


def removals(docs: DataFrame, size: Repeats = Repeats()) -> DataFrame:
    """(doc_id, text_key, low, high): word ranges of each document that an earlier one has."""
    keyed = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    fit, copies = _grouped(keyed, size)

    def ranges(tree: _Tree, doc: np.ndarray, key: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        at = tree.later(doc, size.window)
        of = np.searchsorted(tree.first, at, "right") - 1
        begin = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])]) if len(at) else at
        last = np.r_[begin[1:], len(at)][: len(begin)] - 1
        who = of[begin]
        shift = place[who] - tree.first[who]
        return pa.record_batch([pa.array(x) for x in (doc[who], key[who], at[begin] + shift, at[last] + size.window + shift)], ["doc_id", "text_key", "low", "high"])

    inside = _trees(fit, size, ranges, "doc_id long, text_key long, low long, high long")
    return inside.unionByName(copies.select("doc_id", "text_key", F.col("place").alias("low"), (F.col("place") + F.col("n_words")).alias("high")))


def maximal_repeats(docs: DataFrame, size: Repeats = Repeats()) -> DataFrame:
    """(doc_id, place, n_words, n, n_docs): repeats of at least a window in two documents or more.

    One row for each: its least document, a place of its words there, how many they are, and how often and in how many
    documents they occur. They are the deep internal nodes of the trees that have different words before them; a repeat
    longer than a stretch is listed by stretches. Where a group did not fit, a stretch with copies is listed with them
    and one place in the least document whose stretch has the same ends, and takes part in the tree below it once.
    """
    keyed = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    fit, copies = _grouped(keyed, size)

    def nodes(tree: _Tree, doc: np.ndarray, key: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        out = []
        for depth, i, j in tree.deep_nodes(size.window):
            own = doc[tree.owner[i:j]]
            if own.min() == own.max():
                continue
            k = i + int(own.argmin())
            out.append((int(own.min()), int(tree.place[k] - tree.first[tree.owner[k]] + place[tree.owner[k]]), depth, j - i, len(np.unique(own))))
        return pa.record_batch([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], ["doc_id", "place", "n_words", "n", "n_docs"])

    least = [F.min("least").alias("_id"), F.min_by("least_place", "least").alias("_place")]
    whole = copies.groupBy("prefix", "name", "n_words").agg(*least, (F.count("*") + 1).alias("n"), (F.count_distinct("doc_id") + 1).alias("n_docs")).drop("prefix", "name")
    inside = _trees(fit, size, nodes, "doc_id long, place long, n_words long, n long, n_docs long")
    return inside.unionByName(whole.withColumnsRenamed({"_id": "doc_id", "_place": "place"}))


def _with_removals(docs: DataFrame, size: Repeats) -> DataFrame:
    gone = removals(docs.select("doc_id", "text"), size).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_list(F.struct("low", "high")).alias("gone"))
    return docs.join(gone, (docs["doc_id"] == gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_key"]), "left").drop("_id", "_key")


def _kept(text: bytes, gone: list | None) -> tuple[list[bytes], int]:
    found = text.split()
    if not gone:
        return found, len(found)
    edge = np.zeros(len(found) + 1, np.int64)
    for r in gone:
        edge[r["low"]] += 1
        edge[r["high"]] -= 1
    return [w for w, g in zip(found, np.cumsum(edge).tolist()) if not g], len(found)


def repeat_report(docs: DataFrame, size: Repeats = Repeats()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of (doc_id, text)."""

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        n, removed, sha = [], [], []
        for text, gone in zip(text_bytes(part), part.column("gone").to_pylist()):
            kept, total = _kept(text, gone)
            n.append(total)
            removed.append(total - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return map_slices(_with_removals(docs.select("doc_id", "text"), size), rows, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def drop_repeats(docs: DataFrame, size: Repeats = Repeats()) -> DataFrame:
    """(doc_id, text) of every row with the kept words joined by one blank; a text that loses nothing stays as it is."""

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        was = part.column("text").to_pylist()
        text = [x if x is None or not gone else b" ".join(_kept(x.encode(), gone)[0]).decode() for x, gone in zip(was, part.column("gone").to_pylist())]
        return pa.record_batch([part.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return map_slices(_with_removals(docs.select("doc_id", "text"), size), rows, "doc_id long, text string")
