"""An interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the workers that score.

1. Words are counted. Each range of word hashes is written as one sorted array;
   a word's id is its place in all of them.
2. Bigrams of ids are counted: a map task combines those of its whole partition,
   a shard is merged, written as sorted arrays of keys and counts, and yields what
   its contexts and its followers have (totals, how many were seen once, twice,
   more often, and from how many words a word follows).
3. These are added up per range of ids and written beside the words.
4. Scoring tasks map the arrays and search them for the distinct words and bigrams
   of a slice of texts. Nothing of the model passes the driver but sizes,
   counts of counts and the contexts that are hot.

Shards go by the first id; a context with more tokens than a shard's share is
split over shards of its own by the second id. The order is two because counts
of three words would need more disk than a few times the input.

Files lie in the folder that the cluster shares, which has to be mounted on all
machines: that is what mapping needs. They are written under another name first,
so a repeated task leaves whole files only.

Defined cases: a null or empty text is one end token; white space cuts words;
without training rows every token has probability one over one unknown word;
repeated rows count as often as they are there; where the counts of counts give no
discounts, as in a corpus whose rows all repeat, 0.5, 1 and 1.5 are taken, so that
no text has probability zero. Words are numbered in 32 bits: 4 billion
distinct words at most, beyond which training fails.
"""

from __future__ import annotations

import os
import shutil
import uuid
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayscope.llm.textarrays import NOT_SPACE, firsts, joined, map_slices, range_hash, slices, text_bytes, words
from stayscope.session import shared_folder, written_table

#: Hash of the end of a text, a token like any word
_END = np.uint64(0x5EED0FE11D0C0FFE)
_SHARD_TOKENS = 2_000_000
_HELD = 4_000_000


@dataclass(frozen=True)
class Model:
    folder: str
    base: np.ndarray  # first id of each range of word hashes, and the number of words last
    tokens: int
    bigrams: int
    shards: int
    hot: np.ndarray  # ids of contexts that are split
    hot_base: np.ndarray  # first shard of each
    hot_parts: np.ndarray
    discount: np.ndarray  # of bigrams seen once, twice, more often
    base_discount: np.ndarray  # of words after one, two, more words
    base_rest: float  # mass that the words leave to the unknown and to all alike

    @property
    def size(self) -> int:
        return int(self.base[-1])

    def delete(self) -> None:
        shutil.rmtree(self.folder)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end, and the first token of each text."""
    data, begin = joined(texts)
    low = np.frombuffer(data.tobytes().lower(), np.uint8)
    start, end = words(low, NOT_SPACE)
    first = firsts(start, begin)
    return np.insert(range_hash(low, start, end, seed=61), first[1:], _END), first + np.arange(len(first))


def _save(folder: str, name: str, array: np.ndarray) -> None:
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    array.tofile(part)
    os.replace(part, f"{folder}/{name}")


@lru_cache(maxsize=2000)
def _mapped(path: str, kind: str) -> np.ndarray:
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)


def _combine(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[cut], np.add.reduceat(counts[order].astype(np.int64), cut) if len(cut) else np.zeros(0, np.int64)


def _counted(df: DataFrame, keys_of, group_of) -> DataFrame:
    """(group, keys, counts): keys of all slices, combined per task, in rows of one group each."""

    def run(batches):
        held: list = []

        def flush():
            keys, counts = _combine(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            group = group_of(keys)
            order = np.argsort(group, kind="stable")
            keys, counts, group = keys[order], counts[order], group[order]
            cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else []
            edge = np.r_[cut, len(group)].astype(np.int64)
            rows = [(int(group[i]), keys[i:j].tobytes(), counts[i:j].astype(np.uint32).tobytes()) for i, j in zip(edge[:-1], edge[1:])]
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["group", "keys", "counts"])

        size = 0
        for batch in batches:
            for part in slices(batch):
                held.append(np.unique(keys_of(text_bytes(part)), return_counts=True))
                size += len(held[-1][0])
                if size > _HELD:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    return df.select("text").mapInArrow(run, "group int, keys binary, counts binary")


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")])
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("counts")])
    return _combine(keys, counts)


def _ids(model_base: np.ndarray, folder: str, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id (-1: unknown) and count of sorted distinct word hashes."""
    parts = len(model_base) - 1
    ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
    of = _word_range(hashes, parts)
    edge = np.searchsorted(of, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edge)):
        if model_base[p] == model_base[p + 1]:
            continue
        known = _mapped(f"{folder}/words-{p}", "u8")
        own = hashes[edge[p] : edge[p + 1]]
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        hit = np.flatnonzero(known[at] == own)
        ids[edge[p] + hit] = model_base[p] + at[hit]
        counts[edge[p] + hit] = _mapped(f"{folder}/counts-{p}", "u8")[at[hit]]
    return ids, counts


def _word_range(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _pairs(prev: np.ndarray, following: np.ndarray) -> np.ndarray:
    return (prev.astype(np.uint64) << np.uint64(32)) | following.astype(np.uint64)


def _contexts(ids: np.ndarray, first: np.ndarray, begin: int) -> np.ndarray:
    """Id before each token; ``begin`` before the first of a text."""
    prev = np.empty_like(ids)
    prev[1:] = ids[:-1]
    prev[first[:-1]] = begin
    return prev


def _shard_of(keys: np.ndarray, size: int, shards: int, hot: np.ndarray, hot_base: np.ndarray, hot_parts: np.ndarray) -> np.ndarray:
    prev, following = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    out = prev * shards // (size + 1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, prev), len(hot) - 1)
        split = hot[at] == prev
        out[split] = hot_base[at[split]] + following[split] * hot_parts[at[split]] // max(size, 1)
    return out


#: Discounts where the counts of counts give no estimate between nothing and the whole count
_FALLBACK = np.array([0.5, 1.0, 1.5])


def _discounts(seen: np.ndarray) -> np.ndarray:
    """The three discounts from how many are counted once, twice, three and four times; always positive.

    Small or repeated corpora may have no such counts, or estimates out of range; then all three are ``_FALLBACK``.
    """
    n1, n2, n3, n4 = (float(x) for x in seen)
    if not (n1 and n2 and n3):
        return _FALLBACK
    y = n1 / (n1 + 2 * n2)
    d = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return d if (d > 0).all() and (d <= [1.0, 2.0, 3.0]).all() else _FALLBACK


def _few(counts: np.ndarray) -> np.ndarray:
    return np.array([(counts == k).sum() for k in (1, 2, 3, 4)], np.int64)


def train(docs: DataFrame) -> Model:
    """Count the texts of ``docs``; they are read twice."""
    spark = docs.sparkSession
    folder = _model_folder(spark)
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def merge_words(table: pa.Table) -> pa.Table:
        p = table.column("group")[0].as_py()
        keys, counts = _merged(table)
        _save(folder, f"words-{p}", keys)
        _save(folder, f"counts-{p}", counts)
        return pa.table({"group": pa.array([p], pa.int32()), "n": pa.array([len(keys)]), "total": pa.array([int(counts.sum())])})

    found = _counted(docs, lambda texts: _tokens(texts)[0], lambda keys: _word_range(keys, parts))
    sizes = found.groupBy("group").applyInArrow(merge_words, "group int, n long, total long").collect()
    base = np.zeros(parts + 1, np.int64)
    for r in sizes:
        base[r["group"] + 1] = r["n"]
    base, tokens = np.cumsum(base), sum(r["total"] for r in sizes)
    size = int(base[-1])
    if size >= 2**32 - 1:
        raise ValueError("ids of words take 32 bits")

    # contexts with more tokens than a shard's share: at most as many as there are shards
    shards = max(8, tokens // _SHARD_TOKENS)

    def heavy(batches):
        for batch in batches:
            for p in batch.column("id").to_pylist():
                if base[p] < base[p + 1]:
                    counts = _mapped(f"{folder}/counts-{p}", "u8")
                    at = np.flatnonzero(counts > tokens / shards)
                    yield pa.record_batch([pa.array(base[p] + at), pa.array(counts[at].astype(np.int64))], ["id", "n"])

    heavy_rows = sorted((r["id"], r["n"]) for r in spark.range(0, parts, 1, parts).mapInArrow(heavy, "id long, n long").collect())
    ends = _ids(base, folder, np.array([_END]))[1][0]
    if ends > tokens / shards:
        heavy_rows.append((size, int(ends)))  # as many texts begin as end
    hot = np.array([i for i, _ in heavy_rows], np.int64)
    hot_parts = np.array([-(-n * shards // max(tokens, 1)) for _, n in heavy_rows], np.int64)
    hot_base = shards + np.cumsum(hot_parts) - hot_parts if len(hot) else hot

    def bigram_keys(texts: list[bytes]) -> np.ndarray:
        token, first = _tokens(texts)
        distinct, back = np.unique(token, return_inverse=True)
        ids = _ids(base, folder, distinct)[0][back]
        return _pairs(_contexts(ids, first, size), ids)

    def merge_bigrams(table: pa.Table) -> pa.Table:
        shard = table.column("group")[0].as_py()
        keys, counts = _merged(table)
        _save(folder, f"bigrams-{shard}", keys)
        # four bytes a count unless one needs eight
        _save(folder, f"bigram-counts-{shard}", counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else np.uint64))
        prev, following = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, prev[1:] != prev[:-1]])
        add = lambda x: np.add.reduceat(x.astype(np.int64), cut)
        context = prev[cut], add(counts), add(counts == 1), add(counts == 2), add(counts > 2)
        after = np.unique(following, return_counts=True)
        out = {k: [] for k in ("group", "kind", "ids", "values")}
        seen = _few(counts)
        for kind, (ids, *values) in enumerate((context, after)):
            where = np.minimum(np.searchsorted(base, ids, "right") - 1, parts - 1)
            edge = np.searchsorted(where, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(edge)):
                own = slice(edge[p], edge[p + 1])
                out["group"].append(int(p))
                out["kind"].append(kind)
                out["ids"].append((ids[own] - base[p]).astype(np.uint32).tobytes())
                out["values"].append(np.concatenate([v[own] for v in values]).astype(np.uint32 if kind or values[0].max() < 2**32 else np.uint64).tobytes())
        out["group"].append(-1)
        out["kind"].append(2)
        out["ids"].append(b"")
        out["values"].append(np.r_[seen, len(keys)].astype(np.int64).tobytes())
        return pa.table({"group": pa.array(out["group"], pa.int32()), "kind": pa.array(out["kind"], pa.int32()), "ids": pa.array(out["ids"], pa.binary()), "values": pa.array(out["values"], pa.binary())})

    found = _counted(docs, bigram_keys, lambda keys: _shard_of(keys, size, shards, hot, hot_base, hot_parts))
    stats = written_table(found.groupBy("group").applyInArrow(merge_bigrams, "group int, kind int, ids binary, values binary"), "bigram-stats")
    totals = sum((np.frombuffer(bytes(r["values"]), np.int64) for r in stats.filter("group = -1").select("values").collect()), np.zeros(5, np.int64))
    discount = _discounts(totals[:4])

    def add_up(table: pa.Table) -> pa.Table:
        p = table.column("group")[0].as_py()
        n = int(base[p + 1] - base[p]) + (p == parts - 1)  # the begin of texts comes last
        total, few, after = np.zeros(n, np.int64), np.zeros((3, n), np.int64), np.zeros(n, np.int64)
        for kind, ids, values in zip(table.column("kind").to_pylist(), table.column("ids"), table.column("values")):
            ids = np.frombuffer(ids.as_buffer(), np.uint32)
            wide = len(values.as_buffer()) == 8 * len(ids) * (1 if kind else 4)
            values = np.frombuffer(values.as_buffer(), np.uint64 if wide else np.uint32).astype(np.int64)
            if kind:
                after[ids] += values
            else:
                total[ids] += values[: len(ids)]
                few[:, ids] += values[len(ids) :].reshape(3, -1)
        _save(folder, f"total-{p}", total)
        _save(folder, f"rest-{p}", (discount @ few / np.maximum(total, 1)).astype(np.float32))
        _save(folder, f"after-{p}", after.astype(np.uint32))
        seen = _few(after)
        return pa.table({"n1": [int(seen[0])], "n2": [int(seen[1])], "n3": [int(seen[2])], "n4": [int(seen[3])], "more": [int((after > 2).sum())]})

    sums = stats.filter("group >= 0").groupBy("group").applyInArrow(add_up, "n1 long, n2 long, n3 long, n4 long, more long").collect()
    seen = np.sum([[r[c] for c in ("n1", "n2", "n3", "n4", "more")] for r in sums] or [[0] * 5], axis=0)
    base_discount, bigrams = _discounts(seen[:4]), int(totals[4])
    rest = float(base_discount @ [seen[0], seen[1], seen[4]]) / bigrams if bigrams else 1.0
    return Model(folder, base, tokens, bigrams, int(shards), hot, hot_base, hot_parts, discount, base_discount, rest)


def _model_folder(spark: SparkSession) -> str:
    place = urlparse(shared_folder(spark))
    if place.scheme not in ("", "file"):
        raise RuntimeError(f"workers map the model's files: mount {place.geturl()} and name the mount in spark.checkpoint.dir")
    folder = f"{place.path}/{spark.sparkContext.applicationId}/ngram-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


def _per_id(model: Model, name: str, kind: str, ids: np.ndarray) -> np.ndarray:
    """Values of ascending ids from the ranges' arrays; zero where a range has none."""
    parts = len(model.base) - 1
    where = np.minimum(np.searchsorted(model.base, ids, "right") - 1, parts - 1)
    out = np.zeros(len(ids), np.float64)
    edge = np.searchsorted(where, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(edge)):
        path = f"{model.folder}/{name}-{p}"
        if os.path.exists(path):
            own = slice(edge[p], edge[p + 1])
            out[own] = _mapped(path, kind)[ids[own] - model.base[p]]
    return out


def _less(counts: np.ndarray, discount: np.ndarray) -> np.ndarray:
    """Counts after their discounts."""
    return counts - np.r_[0.0, discount][np.minimum(counts, 3).astype(np.int64)]


def _bigram_counts(model: Model, keys: np.ndarray) -> np.ndarray:
    shard = _shard_of(keys, model.size, model.shards, model.hot, model.hot_base, model.hot_parts)
    order = np.argsort(shard, kind="stable")
    out = np.zeros(len(keys), np.int64)
    edge = np.flatnonzero(np.r_[True, shard[order][1:] != shard[order][:-1], True]) if len(keys) else [0]
    for i, j in zip(edge[:-1], edge[1:]):
        own = order[i:j]
        path = f"{model.folder}/bigrams-{shard[own[0]]}"
        if not os.path.exists(path):
            continue
        known = _mapped(path, "u8")
        at = np.minimum(np.searchsorted(known, keys[own]), len(known) - 1)
        hit = known[at] == keys[own]
        counted = path.replace("/bigrams-", "/bigram-counts-")
        out[own[hit]] = _mapped(counted, "u4" if os.path.getsize(counted) == 4 * len(known) else "u8")[at[hit]]
    return out


def score_texts(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, known tokens, add-one unigram score and model score (both log10) of each text."""
    token, first = _tokens(texts)
    distinct, back = np.unique(token, return_inverse=True)
    ids, counts = _ids(model.base, model.folder, distinct)
    known = ids >= 0
    base = np.log10((counts + 1.0) / (model.tokens + model.size + 1))
    even = 1.0 / (model.size + 1)
    low = np.full(len(ids), model.base_rest * even)
    rank = np.argsort(ids[known], kind="stable")
    some = np.flatnonzero(known)[rank]
    after = _per_id(model, "after", "u4", ids[some])
    low[some] += np.maximum(_less(after, model.base_discount), 0) / max(model.bigrams, 1)
    # distinct bigrams of known words; what follows an unknown word has the shorter context alone
    prev = _contexts(np.where(known, np.arange(len(ids)), -1)[back], first, len(ids))
    of_place = np.r_[ids, model.size]
    p = low[back]
    both = np.flatnonzero((prev >= 0) & (of_place[prev] >= 0))
    context = of_place[prev[both]]
    seen, at = np.unique(context, return_inverse=True)
    total, rest = _per_id(model, "total", "i8", seen)[at], _per_id(model, "rest", "f4", seen)[at]
    following = ids[back[both]]
    pair = np.flatnonzero(following >= 0)
    keys, key_of = np.unique(_pairs(context[pair], following[pair]), return_inverse=True)
    count = np.zeros(len(both))
    count[pair] = _bigram_counts(model, keys)[key_of]
    inside = total > 0
    higher = np.maximum(_less(count, model.discount), 0)
    p[both] = np.where(inside, higher / np.maximum(total, 1) + rest * p[both], p[both])
    cut = first[:-1]
    add = lambda x: np.add.reduceat(x, cut) if len(cut) else np.zeros(0)
    return np.diff(first), add(known[back].astype(np.int64)), add(base[back]), add(np.log10(p))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (with a column text, which goes) and n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    kept = [c for c in docs.columns if c != "text"]

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        n, known, base, total = score_texts(model, text_bytes(part))
        made = {"n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)), "train_tokens": pa.array(np.full(len(n), model.tokens, np.int64)), "base_score": pa.array(base, pa.float64()), "score": pa.array(total, pa.float64()), "perplexity": pa.array(10 ** (-total / n), pa.float64())}
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made.values()], [*kept, *made])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    return map_slices(docs, rows, ", ".join([*fields, "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"]))


def score_held_out(docs: DataFrame, parts: int = 7, part: int = 2) -> DataFrame:
    """Train on the rows of (doc_id, text) whose checksum of the id leaves another rest, score all."""
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts == part
    return score(docs.select("doc_id", "text", out.alias("held_out")), train(docs.filter(~out)))
