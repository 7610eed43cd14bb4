"""Fingerprints by Order MinHash, and how alike documents and edited documents are.

A text's k-mers of words are numbered by occurrence. For each of ``tuples`` hash
functions the ``take`` numbered k-mers of least hash are chosen, put in the
order of the text and hashed together. The share of equal tuples falls with the
edit distance and, unlike a set's, with moved text.

Defined cases: a text of fewer than ``k`` words has its words as one k-mer, one
without words has a fixed fingerprint; fewer numbered k-mers than ``take`` are
all taken; null is empty; rows without an id come last, and rows of one id, or of
none, follow each other by descending hash of their texts. Texts with equal words have
equal fingerprints. Rows alike in id and text share a range.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayscope.llm.textarrays import NOT_SPACE, firsts, joined, mix, range_hash, sequence_hash, words

_RANGE_BYTES = 64 << 20


def signatures(texts: list[bytes], k: int = 2, take: int = 2, tuples: int = 32) -> np.ndarray:
    """One row of ``tuples`` 32-bit hashes for each text."""
    out = np.zeros((len(texts), tuples), np.uint32)
    data, begin = joined(texts)
    start, end = words(data, NOT_SPACE)
    first = firsts(start, begin)
    symbol = range_hash(data, start, end, seed=31)
    size = np.diff(first)
    # k-mers that lie in one text; a short text gives one of what it has
    gram = np.zeros(len(symbol), np.uint64)
    whole = sequence_hash(symbol, k)
    gram[: len(whole)] = whole
    for i in np.flatnonzero((size > 0) & (size < k)):
        a = first[i]
        gram[a] = sequence_hash(symbol[a : a + size[i]], int(size[i]))[0]
    count = np.where(size > 0, np.maximum(size - k + 1, 1), 0)
    at = np.cumsum(count) - count
    place = np.repeat(first[:-1] - at, count) + np.arange(int(count.sum()))
    gram, of = gram[place], np.repeat(np.arange(len(texts)), count)
    if not len(gram):
        return out
    # number the occurrences of each k-mer inside its text
    own = mix(gram + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    same = own[order[1:]] == own[order[:-1]]
    rank = np.arange(len(own))
    begins = np.maximum.accumulate(np.where(np.r_[False, same], 0, rank))
    number = np.empty(len(own), np.uint64)
    number[order] = (rank - begins).astype(np.uint64)
    base = mix(gram + number * np.uint64(0xD6E8FEB86659FD93))
    filled = np.flatnonzero(count)
    cut = at[filled]
    length = count[filled]
    top = np.uint64(2**64 - 1)
    for t in range(tuples):
        factor = np.uint64((0x9E3779B97F4A7C15 * (2 * t + 1)) % 2**64 | 1)
        h = base * factor
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        picked = []
        for j in range(take):
            least = np.minimum.reduceat(h, cut)
            hit = np.flatnonzero(h == np.repeat(least, length))
            hit = hit[np.r_[True, of[hit[1:]] != of[hit[:-1]]]]
            picked.append(np.where(length > j, hit, -1))
            h[hit] = top
        picked = np.sort(np.stack(picked, axis=1), axis=1)
        code = np.full(len(filled), t + 1, np.uint64)
        for j in range(take):
            code = mix(code * np.uint64(0x100000001B3) + np.where(picked[:, j] >= 0, base[np.maximum(picked[:, j], 0)], np.uint64(0)))
        out[filled, t] = code.astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal tuples, row by row."""
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _in_ranges(docs: DataFrame, parts: int, total: int) -> DataFrame:
    """Rows with the range of their place in the order; the first of each range also closes the range above, the last one's as its ghost.

    The order is by id (``rank``; null as the least) and hash of the text. Bounds of
    the ranges and the largest key of each are at most ``parts`` of either.
    """
    share = 64 * parts / max(total, 1)
    ids = docs.select("rank", "hash", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"))
    drawn = ids.filter(F.pmod(F.xxhash64("rank", "hash"), F.lit(1 << 40)) / float(1 << 40) < F.col("size") * share)
    # equal rows are drawn together and collected as one
    drawn = drawn.groupBy("rank", "hash").agg(F.sum(F.greatest(F.lit(1.0), F.col("size") * share)).alias("weight"))
    got = sorted(map(tuple, drawn.collect()))
    bounds = []
    if got:
        upto = np.cumsum([w for *_, w in got])
        at = np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts)
        bounds = sorted({got[i][:2] for i in at})
    by_rank, by_hash = (np.array([x[i] for x in bounds], np.int64) for i in (0, 1))

    def place(batches):
        for batch in batches:
            rank, hashed = (batch.column(c).to_numpy() for c in ("rank", "hash"))
            at, upto = np.searchsorted(by_rank, rank, "left"), np.searchsorted(by_rank, rank, "right")
            for i in np.flatnonzero(at < upto):
                at[i] += np.searchsorted(by_hash[at[i] : upto[i]], hashed[i], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], [*batch.schema.names, "range"])

    placed = ids.select("rank", "hash").mapInArrow(place, "rank long, hash long, range int")
    heads = sorted((r["range"], tuple(r["head"])) for r in placed.groupBy("range").agg(F.max(F.struct("rank", "hash")).alias("head")).collect())
    head = {key: heads[(i + 1) % len(heads)][0] for i, (_, key) in enumerate(heads)}
    hashes = np.array([h for _, h in head], np.int64)

    def copy(batches):
        copied = set()  # one ghost of a task will do for equal rows
        for batch in place(batches):
            rank, hashed = (batch.column(c).to_numpy() for c in ("rank", "hash"))
            ghosts = []
            for i in np.flatnonzero(np.isin(hashed, hashes)).tolist():
                key = int(rank[i]), int(hashed[i])
                if key in head and key not in copied:
                    copied.add(key)
                    ghosts.append((i, head[key]))
            flag = lambda b, g: pa.RecordBatch.from_arrays([*b.columns, pa.array([g] * b.num_rows, pa.bool_())], [*b.schema.names, "ghost"])
            yield flag(batch, False)
            if ghosts:
                again = batch.take(pa.array([i for i, _ in ghosts]))
                to = pa.array([r for _, r in ghosts], pa.int32())
                yield flag(pa.RecordBatch.from_arrays([*again.columns[:-1], to], batch.schema.names), True)

    return docs.mapInArrow(copy, "doc_id long, text string, rank long, hash long, range int, ghost boolean")


def fingerprints(docs: DataFrame, k: int = 2, take: int = 2, tuples: int = 32) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next document is the next by descending id, after the last the first.
    Texts are shuffled once, by ranges of ids and text hashes that hold about equal
    bytes; a range's largest document is copied to the range above, where it follows the
    smallest.
    """
    keyed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("rank"), F.xxhash64("text").alias("hash"))
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // _RANGE_BYTES + 1)
    ranged = _in_ranges(keyed, parts, total)
    ordered = ranged.repartitionById(parts, "range").sortWithinPartitions("range", "ghost", F.desc("rank"), F.desc("hash"))

    def report(rows: list[tuple]) -> pa.RecordBatch:
        """Rows are (doc_id, text, text of the next)."""
        plain, after = [r[1] or "" for r in rows], [r[2] or "" for r in rows]
        changed = [edited(a, b) for a, b in zip(plain, after)]
        coded = [x.encode() for x in changed]
        distinct: dict[str, int] = {}
        for x in [*plain, *after, *changed]:
            distinct.setdefault(x, len(distinct))
        sign = np.zeros((len(distinct), tuples), np.uint32)
        texts = [x.encode() for x in distinct]
        a = 0
        while a < len(texts):
            b, size = a + 1, len(texts[a])
            while b < len(texts) and size + len(texts[b]) <= 2 << 20:
                size += len(texts[b])
                b += 1
            sign[a:b] = signatures(texts[a:b], k, take, tuples)
            a = b
        own, follow, new = (sign[[distinct[x] for x in xs]] for xs in (plain, after, changed))
        hexed = lambda s: pa.array([v.astype(">u4").tobytes().hex() for v in s], pa.string())
        columns = [
            pa.array([r[0] for r in rows], pa.int64()), pa.array([len(x) for x in plain], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
            hexed(own), hexed(new), pa.array(likeness(own, new)), pa.array(likeness(own, follow)),
        ]
        return pa.record_batch(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        held, size, previous = [], 0, None  # previous: the row that still waits for its next one
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("range", "ghost", "doc_id", "text"))):
                if previous and previous[0] == row[0] and not previous[1]:
                    held.append((previous[2], previous[3], row[3]))
                    size += len(previous[3] or "")
                previous = row
                if size > 2 << 20 or len(held) >= 2000:
                    yield report(held)
                    held, size = [], 0
        if held:
            yield report(held)

    return ordered.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
