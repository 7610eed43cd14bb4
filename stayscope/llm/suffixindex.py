"""Byte strings of a given length that already start earlier are removed, by a logarithmic family of suffix arrays.

A suffix is a byte position with ``length`` bytes before the end of its document;
its window are these bytes. Spark deals suffixes to tasks by a prefix from inside their window:
the run of ``prefix`` bytes with the least hash, which equal windows share.
Consecutive suffixes of one prefix travel as one stretch of text. Prefixes that occur
once cannot repeat and are left out.

In a task the stretches come in batches, in the order of their documents. A new
batch gets a suffix array; it is scanned in merge order against the suffix arrays
of the levels there are, and a suffix whose window is found there, or earlier in its own
batch, starts a repeat. What is new becomes a level, and levels of like size merge,
so that a family of n suffixes has about log n levels and each suffix is merged as often.

Copies never meet in number: of equal texts the earliest alone is searched, the others
are repeats as a whole, and of equal stretches in one slice of documents all but
the earliest are repeats at once and do not travel. A prefix with more than ``group``
stretches is dealt by salts first, where equal stretches collapse again; the
earliest ones meet under their prefix or, if still more than ``group`` are unlike,
under a prefix of the whole window, whose order is a grouped minimum. Hence no
group exceeds a task's memory and no repeat is lost.

Defined cases: null texts are empty; rows without an id are one document after
all others, rows of one id are one document, and equal starts in them are not
earlier than each other; texts shorter than ``length`` lose nothing; overlapping
repeats are removed as their union, judged on the input.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from stayscope.llm.textarrays import joined, least_run, map_slices, mix, packed, powers, range_hash, text_bytes, unpacked, whole_groups, with_fields
from stayscope.session import delete_path, written_path, written_table

_BASE = 0x27BB2EE687B0B0FD
_LAST = 2**63 - 1
#: Positions that are hashed at once, few enough for a core's cache; longer texts are cut with an overlap of a window
_BLOCK = 1 << 16
_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))
_SALTS = 64
_GONE = "doc_key long, id long, low long, high long"


@dataclass(frozen=True)
class Repeats:
    length: int = 100
    prefix: int = 24
    group: int = 4000
    #: Suffixes of a batch, and rows that a task holds
    batch: int = 20_000
    rows: int = 3000


@lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    return powers(_BASE, n), powers(pow(_BASE, -1, 2**64), n)


def _prefix_hashes(data: np.ndarray, size: int) -> np.ndarray:
    up, down = _powers(1 << len(data).bit_length())
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: len(data) - size + 1])


def stretches(texts: list[bytes], size: Repeats):
    """All texts as one array, and of each stretch: its text, first byte there, number of suffixes and prefix."""
    data, begin = joined(texts)
    # the byte after a text is not its own, so the last windows begin before these
    last = np.maximum(begin[1:] - size.length, begin[:-1])
    edges = np.unique(np.r_[begin[:-1], last])
    found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)]
    for a in range(0, max(len(data) - size.length + 1, 0), _BLOCK):
        key = _prefix_hashes(data[a : a + _BLOCK + size.length - 1], size.prefix)
        at = least_run(key, size.length - size.prefix + 1)
        change = np.r_[True, at[1:] != at[:-1]]
        change[edges[slice(*np.searchsorted(edges, (a, a + len(at))))] - a] = True
        first = np.flatnonzero(change)
        n = np.diff(np.r_[first, len(at)])
        of = np.searchsorted(begin, a + first, "right") - 1
        real = a + first < last[of]
        found.append((of[real], a + first[real], n[real], key[at[first[real]]]))
    return data, begin, *(np.concatenate(x) for x in zip(*found))


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``id``, never null, and ``doc_key``, one for rows alike in id and text."""
    named = docs.withColumn("id", F.coalesce(F.col("doc_id"), F.lit(_LAST)))
    return named.withColumn("doc_key", F.xxhash64("id", F.coalesce("text", F.lit(""))))


def _copies(keyed: DataFrame) -> DataFrame:
    """(doc_key, id, size): documents whose whole text an earlier id has; only hashes of 128 bits travel."""
    text = F.coalesce("text", F.lit(""))
    # the seed of a hash is what went before, so the second is another function of the text
    narrow = keyed.select("doc_key", "id", F.octet_length(text).cast("long").alias("size"), F.xxhash64(text).alias("hi"), F.xxhash64(F.lit(1), text).alias("lo"))
    first = narrow.groupBy("hi", "lo").agg(F.min("id").alias("least"))
    return narrow.join(first, ["hi", "lo"]).filter("id > least").select("doc_key", "id", "size").distinct()


def _wanted(keyed: DataFrame, size: Repeats) -> DataFrame:
    """(doc_key, few, many): prefixes of each document that recur, apart for those of more than ``group`` stretches."""

    def counts(part: pa.RecordBatch) -> pa.RecordBatch:
        key, n = np.unique(stretches(text_bytes(part), size)[-1], return_counts=True)
        return pa.record_batch([pa.array(key.view(np.int64)), pa.array(n)], ["prefix", "n"])

    def own(part: pa.RecordBatch) -> pa.RecordBatch:
        *_, of, _, _, key = stretches(text_bytes(part), size)
        order = np.lexsort((key, of))
        of, key = of[order], key[order]
        new = np.r_[True, (of[1:] != of[:-1]) | (key[1:] != key[:-1])][: len(of)]
        return pa.record_batch([pa.array(key[new].view(np.int64)), part.column("doc_key").take(pa.array(of[new]))], ["prefix", "doc_key"])

    shared = map_slices(keyed.select("text"), counts, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")).filter("n > 1")
    met = map_slices(keyed.select("doc_key", "text"), own, "prefix long, doc_key long").join(shared, "prefix")
    many = F.col("n") > size.group
    return met.groupBy("doc_key").agg(F.collect_set(F.when(~many, F.col("prefix"))).alias("few"), F.collect_set(F.when(many, F.col("prefix"))).alias("many"))


def _pairs(part: pa.RecordBatch, column: str) -> np.ndarray:
    """A number for each pair of row and listed prefix."""
    lists = part.column(column)
    of = np.repeat(np.arange(part.num_rows), lists.value_lengths().fill_null(0).to_numpy())
    return _pair(of, lists.flatten().to_numpy().view(np.uint64))


def _pair(of: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(key ^ mix(of.astype(np.uint64)))


def _found(keyed: DataFrame, wanted: DataFrame, size: Repeats) -> DataFrame:
    """Stretches that may repeat, as (doc_key, id, low, high, prefix, salt, span).

    A stretch whose equal in the same slice is earlier comes without a span: it is a repeat.
    """

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        data, begin, of, place, n, key = stretches(text_bytes(part), size)
        pair = _pair(of, key)
        many = np.isin(pair, _pairs(part, "many"))
        pick = np.flatnonzero(many | np.isin(pair, _pairs(part, "few")))
        of, place, n, key, many = of[pick], place[pick], n[pick], key[pick], many[pick]
        ids, doc = part.column("id").to_numpy()[of], part.column("doc_key").to_numpy()[of]
        low, end = place - begin[of], place + n + size.length - 1
        later = _not_first(key, range_hash(data, place, end, seed=71), ids, low)
        # a repeat goes where its document's hash points; it has nothing to meet
        prefix = np.where(later, doc, key.view(np.int64))
        salt = np.where(later, -1, np.where(many, 1 + doc % _SALTS, 0)).astype(np.int32)
        flat = memoryview(data.tobytes())
        span = [None if x else bytes(flat[a:b]) for a, b, x in zip(place.tolist(), end.tolist(), later.tolist())]
        made = [doc, ids, low, low + n + size.length - 1, prefix, salt]
        return pa.record_batch([*map(pa.array, made), pa.array(span, pa.binary())], ["doc_key", "id", "low", "high", "prefix", "salt", "span"])

    return map_slices(keyed.join(wanted, "doc_key"), rows, _GONE + ", prefix long, salt int, span binary")


def _not_first(key: np.ndarray, content: np.ndarray, ids: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Whether an equal stretch, of the same prefix and content, has a lower (id, first byte)."""
    order = np.lexsort((low, ids, content, key))
    same = (key[order][1:] == key[order][:-1]) & (content[order][1:] == content[order][:-1])
    first = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(order)), 0)) if len(order) else order
    out = np.zeros(len(order), bool)
    least = order[first]
    out[order] = (ids[order] != ids[least]) | (low[order] != low[least])
    return out


class SuffixArrays:
    """A logarithmic family: texts with the sorted starts of windows in them, no two of which are equal."""

    def __init__(self, length: int):
        self.length, self.levels = length, []

    def windows(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        every = np.lib.stride_tricks.sliding_window_view(data, self.length)
        return np.ascontiguousarray(every[starts]).view(f"S{self.length}").ravel()

    def known(self, ordered: np.ndarray) -> np.ndarray:
        """Which of some sorted windows a level has."""
        out = np.zeros(len(ordered), bool)
        for data, starts in self.levels:
            level = self.windows(data, starts)
            at = np.minimum(np.searchsorted(level, ordered), len(level) - 1)
            out |= level[at] == ordered
        return out

    def add(self, data: np.ndarray, starts: np.ndarray) -> None:
        """A level of sorted new windows; while the one before is not twice as large, both become one."""
        if not len(starts):
            return
        self.levels.append((data, starts))
        while len(self.levels) > 1 and len(self.levels[-2][1]) < 2 * len(self.levels[-1][1]):
            (a, first), (b, second) = self.levels[-2:]
            data, starts = np.r_[a, b], np.r_[first, second + len(a)]
            # two sorted runs, which a stable sort merges
            self.levels[-2:] = [(data, starts[np.argsort(self.windows(data, starts), kind="stable")])]


def family_repeats(spans: list[bytes], ids: np.ndarray, low: np.ndarray, size: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, low, high) of the bytes to remove from rows of text that start at byte ``low`` of document ``ids``."""
    family = SuffixArrays(size.length)
    out = [(np.zeros(0, np.int64),) * 3]
    rows = np.lexsort((low, ids))
    count = np.array([len(s) - size.length + 1 for s in spans], np.int64)
    upto, who = np.cumsum(count[rows]), ids[rows]
    # a batch ends where a document ends
    ends = np.flatnonzero(np.r_[who[1:] != who[:-1], True])
    a = 0
    while a < len(rows):
        before = upto[a] - count[rows[a]]
        b = int(ends[np.searchsorted(ends, min(max(a, int(np.searchsorted(upto, before + size.batch))), len(rows) - 1))]) + 1
        own = rows[a:b]
        a = b
        data = np.frombuffer(b"".join([spans[i] for i in own]), np.uint8)
        n = count[own]
        begin = np.cumsum(n + size.length - 1) - (n + size.length - 1)
        row = np.repeat(np.arange(len(own)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start = low[own][row] + step
        early = np.lexsort((start, ids[own][row]))
        row, start, step = row[early], start[early], step[early]
        place = begin[row] + step
        window = family.windows(data, place)
        order = np.argsort(window, kind="stable")
        ordered = window[order]
        head = np.r_[True, ordered[1:] != ordered[:-1]]
        first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        doc = ids[own][row]
        repeat = np.zeros(len(order), bool)
        old = np.repeat(family.known(ordered[head]), np.diff(np.r_[np.flatnonzero(head), len(order)]))
        repeat[order] = old | (doc[order] != doc[first]) | (start[order] != start[first])
        family.add(data, place[order][head & ~old])
        hit = np.flatnonzero(repeat)
        hit = hit[np.lexsort((step[hit], row[hit]))]
        if len(hit):
            begins = np.r_[True, (row[hit][1:] != row[hit][:-1]) | (step[hit][1:] != step[hit][:-1] + 1)]
            i = np.flatnonzero(begins)
            out.append((own[row[hit[i]]], start[hit[i]], start[hit[np.r_[i[1:], len(hit)] - 1]] + size.length))
    return tuple(np.concatenate(x) for x in zip(*out))


def _meet(found: DataFrame, size: Repeats) -> DataFrame:
    """(doc_key, id, low, high, prefix, span): byte ranges to remove, without a prefix, and stretches of salted prefixes that are left to meet."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.repartition(parts, "prefix", "salt").sortWithinPartitions("prefix", "salt")

    def run(batches):
        for table in whole_groups(batches, ["prefix", "salt"], size.rows):
            salt = table.column("salt").to_numpy()
            done, dealt, whole = (table.filter(pa.array(x)) for x in (salt < 0, salt > 0, salt == 0))
            yield from _rows(done, np.arange(done.num_rows), done.column("low").to_numpy(), done.column("high").to_numpy())
            if dealt.num_rows:
                data, begin = joined(dealt.column("span").to_pylist())
                doc, low = dealt.column("id").to_numpy(), dealt.column("low").to_numpy()
                later = _not_first(dealt.column("prefix").to_numpy(), range_hash(data, begin[:-1], begin[1:] - 1, seed=71), doc, low)
                out = np.flatnonzero(later)
                yield from _rows(dealt, out, low[out], dealt.column("high").to_numpy()[out])
                yield from dealt.filter(pa.array(~later)).select(["doc_key", "id", "low", "high", "prefix", "span"]).to_batches()
            if whole.num_rows:
                doc, low = whole.column("id").to_numpy(), whole.column("low").to_numpy()
                yield from _rows(whole, *_by_prefix(whole, doc, low, size))

    return dealt.mapInArrow(run, _GONE + ", prefix long, span binary")


def _by_prefix(table: pa.Table, doc: np.ndarray, low: np.ndarray, size: Repeats):
    """Equal stretches collapse, the others meet in a family; windows of unlike prefixes are unlike, so they share it."""
    spans = table.column("span").to_pylist()
    data, begin = joined(spans)
    later = _not_first(table.column("prefix").to_numpy(), range_hash(data, begin[:-1], begin[1:] - 1, seed=71), doc, low)
    gone, left = np.flatnonzero(later), np.flatnonzero(~later)
    row, first, last = family_repeats([spans[i] for i in left], doc[left], low[left], size)
    return np.r_[gone, left[row]], np.r_[low[gone], first], np.r_[table.column("high").to_numpy()[gone], last]


def _rows(table: pa.Table, row: np.ndarray, low: np.ndarray, high: np.ndarray):
    n = len(row)
    pick = pa.array(row)
    columns = [table.column("doc_key").take(pick), table.column("id").take(pick), pa.array(low), pa.array(high), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
    yield from pa.table(columns, ["doc_key", "id", "low", "high", "prefix", "span"]).to_batches()


def _whole_windows(stretch: DataFrame, size: Repeats) -> DataFrame:
    """(doc_key, id, low, high) of every suffix of (doc_key, id, low, span) whose window has an earlier start among them."""

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        spans = part.column("span").to_pylist()
        data, begin = joined(spans)
        n = np.array([len(s) - size.length + 1 for s in spans], np.int64)
        of = np.repeat(np.arange(len(spans)), n)
        step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        start = begin[of] + step
        names = [pa.array(range_hash(data, start, start + size.length, seed).view(np.int64)) for seed in (72, 73)]
        own = pa.array(of)
        return pa.record_batch([part.column("doc_key").take(own), part.column("id").take(own), pa.array(part.column("low").to_numpy()[of] + step), *names], ["doc_key", "id", "low", "hi", "lo"])

    each = map_slices(stretch.select("doc_key", "id", "low", "span"), rows, "doc_key long, id long, low long, hi long, lo long", "span")
    # windows found once have nothing later; a written table lets the join split a window that very many have
    least = each.groupBy("hi", "lo").agg(F.min(F.struct("id", "low")).alias("least"), F.count("*").alias("n"))
    least = written_table(least.filter("n > 1").drop("n"), "whole-windows")
    later = each.join(least, ["hi", "lo"]).filter(F.struct("id", "low") > F.col("least"))
    return later.select("doc_key", "id", "low", (F.col("low") + size.length).alias("high"))


def removals(keyed: DataFrame, size: Repeats = Repeats()) -> DataFrame:
    """(doc_key, id, low, high): byte ranges of the texts of (text, id, doc_key) that start a string found earlier."""
    copies = written_table(_copies(keyed), "whole-copies")
    # a copy of a whole text goes at once and takes no part in the search
    wanted, path = written_path(_wanted(keyed, size).join(copies, "doc_key", "left_anti"), "recurring-prefixes")
    met = written_table(_meet(_found(keyed.select("doc_key", "id", "text"), wanted, size), size), "repeats")
    delete_path(keyed.sparkSession, path)
    left = met.filter("prefix IS NOT NULL")
    unlike = left.groupBy("prefix").agg((F.count("*") > size.group).alias("large"))
    left = left.join(unlike, "prefix")
    small = left.filter("NOT large").select("doc_key", "id", "low", "high", "prefix", F.lit(0).alias("salt"), "span")
    out = met.filter("prefix IS NULL").select("doc_key", "id", "low", "high")
    out = out.unionByName(_meet(small, size).select("doc_key", "id", "low", "high"))
    out = out.unionByName(copies.filter(F.col("size") >= size.length).select("doc_key", "id", F.lit(0).cast("long").alias("low"), F.col("size").alias("high")))
    return out.unionByName(_whole_windows(left.filter("large"), size))


def _with_removals(keyed: DataFrame, size: Repeats) -> DataFrame:
    gone = removals(keyed, size).groupBy("doc_key").agg(F.collect_set(F.struct("id", "low", "high")).alias("gone"))
    return keyed.join(gone, "doc_key", "left")


def _removed(text: bytes, doc: int, gone: list | None) -> list[tuple[int, int]]:
    """Maximal removed runs of one text."""
    runs: list[tuple[int, int]] = []
    for low, high in sorted((r["low"], r["high"]) for r in gone or () if r["id"] == doc):
        if runs and low <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], high))
        else:
            runs.append((low, high))
    return runs


def _kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in runs)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in runs), len(text)]))


def repeat_report(docs: DataFrame, size: Repeats = Repeats()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of (doc_id, text)."""

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        made = []
        for text, doc, gone in zip(text_bytes(part), part.column("id").to_pylist(), part.column("gone").to_pylist()):
            runs = _removed(text, doc, gone)
            made.append((len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(text, runs)).hexdigest()))
        n, removed, spans, sha = zip(*made) if made else ((), (), (), ())
        columns = [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, spans)), pa.array(sha, pa.string())]
        return pa.record_batch(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return map_slices(_with_removals(_keyed(docs.select("doc_id", "text")), size), rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def drop_repeats(docs: DataFrame, size: Repeats = Repeats()) -> DataFrame:
    """``docs`` with what is left of each text; a character that lost some of its bytes goes whole. Null texts stay null; ``n_chars``, if there, is counted anew."""
    columns = docs.columns
    keyed = _keyed(packed(docs))
    inner = StructType([keyed.schema[c] for c in ("doc_id", "text", "_rest")])
    schema = with_fields(inner, _n=LongType())

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        kept = []
        for text, null, doc, gone in zip(text_bytes(part), part.column("text").is_null().to_pylist(), part.column("id").to_pylist(), part.column("gone").to_pylist()):
            kept.append(None if null else _kept(text, _removed(text, doc, gone)).decode("utf-8", "ignore"))
        n = pa.array([None if x is None else len(x) for x in kept], pa.int64())
        return pa.record_batch([part.column("doc_id"), pa.array(kept, pa.string()), part.column("_rest"), n], ["doc_id", "text", "_rest", "_n"])

    return unpacked(map_slices(_with_removals(keyed, size), rows, schema), columns, n_chars=F.col("_n"))
