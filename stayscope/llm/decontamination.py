"""Benchmark decontamination over a distributed positional inverted index.

The index holds the postings of every word of every document: a block of
documents gives one row per bucket of terms, with the terms, how often each
occurs and its word positions. A search counts the terms of all benchmark
windows, fetches the postings of each window's two rarest terms only, shifts
them by their offsets in the window and intersects them. What is left is compared
with the whole window in the document, which decides.

Terms are 64-bit hashes of words; all words of a window have to agree. Index and
queries meet by an equality join on the bucket of the term, whose sides Spark
measures before it broadcasts one; the terms of a bucket come in rows of bounded
size.

What is searched are distinct windows, whatever the number of items that share one.
Windows of the same items have one owner, a name for that set of items; documents
meet owners, and owners their items, only after the search. So one passage in many
items costs no more than its occurrences and the lists that the result consists of.

Defined cases: null or empty texts have no words; an item of fewer words than
the window, but not none, is one window; items without words match nothing; rows
of one document id are each judged, and so are documents without an id; items of
one id count once, items without an id mark words but are not listed; repeated
windows count once. The rarest words of a window are chosen by count, then offset.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from stayscope.llm.textarrays import WORDLIKE, firsts, joined, map_slices, packed, range_hash, signed, slices, text_bytes, unpacked, with_fields, words
from stayscope.session import delete_path, written_path, written_table

_BUCKET_BITS = 6
_SLICE = 2 << 20
_SALTS = 8
_TERMS_A_ROW = 16_384
_SPAN = StructType([StructField("window", LongType()), StructField("owner", LongType()), StructField("low", LongType()), StructField("high", LongType())])


def _terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, case folded, and the first of each text."""
    data, begin = joined(texts)
    low = np.frombuffer(data.tobytes().lower(), np.uint8)
    start, end = words(low, WORDLIKE)
    return range_hash(low, start, end, seed=51), firsts(start, begin)


def build_index(docs: DataFrame) -> tuple[DataFrame, str]:
    """The index of (doc_id, text) and where it is written: one row per block and bucket; bucket -1 names the block's documents."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))

    def blocks(batches):
        number = 0
        for batch in batches:
            for part in slices(batch, limit=_SLICE):
                block = (TaskContext.get().partitionId() << 32) | number
                number += 1
                term, first = _terms(text_bytes(part))
                order = np.argsort(term, kind="stable")
                known, at, n = np.unique(term[order], return_index=True, return_counts=True)
                place = order.astype(np.uint32)
                cut = np.searchsorted(known >> np.uint64(64 - _BUCKET_BITS), np.arange((1 << _BUCKET_BITS) + 1))
                edge = np.r_[at, len(order)]
                rows = [(block, b, known[i:j].tobytes(), n[i:j].astype(np.uint32).tobytes(), place[edge[i] : edge[j]].tobytes()) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if j > i]
                ids = np.array([0 if x is None else x for x in part.column("doc_id").to_pylist()], np.int64)
                rows.append((block, -1, ids.tobytes(), part.column("text_key").to_numpy().tobytes(), first.astype(np.int64).tobytes()))
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], ["block", "bucket", "terms", "counts", "places"])

    return written_path(keyed.mapInArrow(blocks, "block long, bucket int, terms binary, counts binary, places binary"), "postings")


def query_windows(items: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (window, size, terms, owner) of ``width`` words of (item_id, text), and the items (owner, item_id) of each owner."""

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        term, first = _terms(text_bytes(part))
        ids, out = part.column("item_id").to_pylist(), []
        for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
            size = min(width, b - a)
            if size:
                out += [(ids[i], int(size), term[k : k + size].view(np.int64).tolist()) for k in range(a, b - size + 1)]
        item, size, terms = zip(*out) if out else ((), (), ())
        return pa.record_batch([pa.array(item, pa.string()), pa.array(size, pa.int32()), pa.array(terms, pa.list_(pa.int64()))], ["item_id", "size", "terms"])

    found = map_slices(items.select(F.col("item_id").cast("string").alias("item_id"), "text"), rows, "item_id string, size int, terms array<long>").distinct()
    named = written_table(found.withColumn("window", F.xxhash64("terms")), "item-windows")
    # sums and parities of hashes name a set of items without collecting it
    item = F.xxhash64("item_id")
    sets = named.groupBy("window", "size", "terms").agg(F.count("item_id").alias("n"), *[F.bit_xor(F.when(F.col("item_id").isNotNull(), h)).alias(c) for c, h in (("one", item), ("two", F.xxhash64(F.lit(1), "item_id")))])
    windows = written_table(sets.select("window", "size", "terms", F.when(F.col("n") > 0, F.xxhash64("n", "one", "two")).alias("owner")), "query-windows")
    # any one window of an owner has its items
    first = windows.filter("owner IS NOT NULL").groupBy("owner").agg(F.min(F.struct("window", "terms")).alias("of")).select("owner", "of.window", "of.terms")
    owned = named.filter("item_id IS NOT NULL").join(first, ["window", "terms"]).select("owner", "item_id")
    return windows, written_table(owned, "owned-items")


def _by_bucket(terms: DataFrame) -> DataFrame:
    """Distinct terms of the queries per bucket, in rows of about ``_TERMS_A_ROW``; written, so that Spark knows its size."""
    distinct = written_table(terms.select("term").distinct(), "distinct-terms")
    pieces = 1 + distinct.count() // (_TERMS_A_ROW << _BUCKET_BITS)
    bucket = F.shiftrightunsigned("term", 64 - _BUCKET_BITS).cast("int")
    rows = distinct.groupBy(bucket.alias("bucket"), F.pmod(F.xxhash64("term"), F.lit(pieces)).alias("piece")).agg(F.collect_list("term").alias("wanted"))
    return written_table(rows.select("bucket", "wanted"), "query-terms")


def _found(part: pa.RecordBatch):
    """For each row of index and wanted terms: its block, terms found, their counts and where their places begin."""
    for i in range(part.num_rows):
        known, n = (np.frombuffer(part.column(c)[i].as_buffer(), kind) for c, kind in (("terms", np.uint64), ("counts", np.uint32)))
        want = np.sort(part.column("wanted")[i].values.to_numpy().view(np.uint64))
        at = np.searchsorted(known, want)
        at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == want)]
        yield i, known[at], n[at].astype(np.int64), at, n


def term_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each queried term occurs in all documents; places are not read."""

    def rows(batches):
        for batch in batches:
            got = [(t, n) for _, t, n, _, _ in _found(batch)]
            if got:
                yield pa.record_batch([signed(np.concatenate([t for t, _ in got])), pa.array(np.concatenate([n for _, n in got]))], ["term", "n"])

    pairs = index.filter("bucket >= 0").select("bucket", "terms", "counts").join(_by_bucket(terms), "bucket").select("terms", "counts", "wanted")
    return pairs.mapInArrow(rows, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def postings(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, block, place) of every occurrence of the queried terms."""

    def rows(batches):
        for batch in batches:
            for i, term, n, at, all_n in _found(batch):
                if not len(term):
                    continue
                places = np.frombuffer(batch.column("places")[i].as_buffer(), np.uint32)
                begin = (np.cumsum(all_n, dtype=np.int64) - all_n)[at]
                pick = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                yield pa.record_batch([signed(np.repeat(term, n)), pa.array(np.full(len(pick), batch.column("block")[i].as_py())), pa.array(places[pick].astype(np.int64))], ["term", "block", "place"])

    pairs = index.filter("bucket >= 0").join(_by_bucket(terms), "bucket").select("block", "terms", "counts", "places", "wanted")
    return pairs.mapInArrow(rows, "term long, block long, place long")


def candidates(index: DataFrame, windows: DataFrame, slop: int = 0) -> DataFrame:
    """(doc_id, text_key, window, start): where a window may begin, or with ``slop`` where its rarest word is."""
    counts = term_counts(index, windows.select(F.explode("terms").alias("term")))
    spread = windows.select("window", "size", F.posexplode("terms").alias("offset", "term"))
    # a window with a word that no document has cannot occur
    # a word of many windows is counted once and joined by as many tasks as there are salts
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    dealt = spread.withColumn("salt", F.pmod(F.xxhash64("window", "offset"), F.lit(_SALTS)).cast("int"))
    seen = dealt.join(counts.withColumn("salt", salts), ["term", "salt"], "left").drop("salt").withColumn("n", F.coalesce("n", F.lit(0)))
    each = Window.partitionBy("window").orderBy("n", "offset")
    rare = seen.withColumn("rank", F.row_number().over(each)).withColumn("least", F.min("n").over(Window.partitionBy("window")))
    rare = written_table(rare.filter(f"least > 0 AND rank <= {1 if slop else 2}").select("window", "size", "offset", "term", "rank"), "rare-terms")
    # a frequent term's places go to as many tasks as there are salts
    salted = rare.withColumn("salt", salts)
    dealt = postings(index, rare).withColumn("salt", F.pmod(F.xxhash64("block", "place"), F.lit(_SALTS)).cast("int"))
    placed = dealt.join(salted, ["term", "salt"]).select("block", "window", "size", "rank", (F.col("place") - (0 if slop else F.col("offset"))).alias("start"))
    if not slop:
        met = placed.filter("start >= 0").groupBy("block", "window", "start", "size").agg(F.count_distinct("rank").alias("met"))
        placed = met.filter(F.col("met") == F.least("size", F.lit(2)))
    names = index.filter("bucket = -1").select(F.col("block").alias("_block"), F.col("terms").alias("ids"), F.col("counts").alias("keys"), F.col("places").alias("firsts"))

    def rows(batches):
        for batch in batches:
            out = [[], [], [], []]
            for i in range(batch.num_rows):
                ids, keys, first = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in ("ids", "keys", "firsts"))
                start = batch.column("starts")[i].values.to_numpy()
                at = np.searchsorted(first, start, "right") - 1
                for o, x in zip(out, (ids[at], keys[at], batch.column("windows")[i].values.to_numpy(), start - first[at])):
                    o.append(x)
            if out[0]:
                yield pa.record_batch([pa.array(np.concatenate(o).astype(np.int64)) for o in out], ["doc_id", "text_key", "window", "start"])

    # lists stay short: one row for each block and a part of its places
    gathered = placed.groupBy("block", F.floor(F.col("start") / 4096).alias("stretch")).agg(F.collect_list("window").alias("windows"), F.collect_list("start").alias("starts"))
    return gathered.join(names, gathered["block"] == names["_block"]).select("windows", "starts", "ids", "keys", "firsts").mapInArrow(rows, "doc_id long, text_key long, window long, start long")


def _nearest(term: np.ndarray, at: int, want: Counter, reach: int) -> tuple[int, int] | None:
    """The first stretch of at most ``reach`` words through ``at`` that has all ``want``."""
    low, high = max(0, at - reach + 1), min(len(term), at + reach)
    have, left = Counter(), low
    for right in range(low, high):
        have[int(term[right])] += 1
        while right - left + 1 > reach:
            have[int(term[left])] -= 1
            left += 1
        if left <= at <= right and all(have[t] >= n for t, n in want.items()):
            return left, right + 1
    return None


def matches(docs: DataFrame, windows: DataFrame, slop: int = 0, rest: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, *rest, n_words, n_hit, spans) of every row of ``docs``.

    ``slop`` 0: words inside exact occurrences of a window are hit. Otherwise a
    window is met where all its words lie within ``slop`` words more than it has,
    in any order. ``spans`` are (window, owner, first word, past last word).
    """
    # the text's hash tells documents without an id apart
    index, path = build_index(docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text"))
    found = candidates(index, windows.select("window", "size", "terms"), slop).join(windows, "window").select("doc_id", "text_key", F.struct("window", "owner", "start", "terms").alias("match"))
    per_doc = found.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_list("match").alias("matches"))
    # the candidates are all that is needed further on
    per_doc = written_table(per_doc, "window-candidates")
    delete_path(docs.sparkSession, path)
    inner = docs.select("doc_id", "text", *rest)
    both = inner.join(per_doc, (F.coalesce(inner["doc_id"], F.lit(0)) == per_doc["_id"]) & (F.xxhash64(inner["text"]) == per_doc["_key"]), "left").drop("_id", "_key")
    kept = inner.columns
    schema = with_fields(inner.schema, n_words=LongType(), n_hit=LongType(), spans=ArrayType(_SPAN))

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        term, first = _terms(text_bytes(part))
        n_words, n_hit, spans = np.diff(first), [], []
        for i, matches in enumerate(part.column("matches")):
            own, true = term[first[i] : first[i + 1]], set()
            for m in matches.as_py() or ():
                want = np.array(m["terms"], np.int64).view(np.uint64)
                if slop:
                    near = _nearest(own, m["start"], Counter(want.tolist()), len(want) + slop)
                    true |= {(m["window"], m["owner"], *near)} if near else set()
                elif np.array_equal(own[m["start"] : m["start"] + len(want)], want):
                    true.add((m["window"], m["owner"], m["start"], m["start"] + len(want)))
            edge = np.zeros(len(own) + 1, np.int64)
            for *_, low, high in true:
                edge[low] += 1
                edge[high] -= 1
            n_hit.append(int((np.cumsum(edge) > 0).sum()))
            spans.append([dict(zip(_SPAN.names, t)) for t in sorted(true, key=lambda t: (t[2], t[3], t[0]))])
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in _SPAN.names]))
        return pa.record_batch([*(part.column(c) for c in kept), pa.array(n_words.astype(np.int64)), pa.array(n_hit, pa.int64()), pa.array(spans, kind)], [*kept, "n_words", "n_hit", "spans"])

    return map_slices(both, rows, schema, limit=_SLICE)


def _with_items(found: DataFrame, owned: DataFrame, kept: list[str]) -> DataFrame:
    """The columns ``kept`` of a written frame with spans, and the sorted items of each row's spans."""
    keyed = written_table(found.withColumn("_row", F.monotonically_increasing_id()), "matched")
    owners = keyed.select("_row", F.explode("spans.owner").alias("owner")).filter("owner IS NOT NULL").distinct()
    listed = owners.join(owned, "owner").groupBy("_row").agg(F.sort_array(F.collect_set("item_id")).alias("_items"))
    none = F.array().cast(ArrayType(StringType()))
    return keyed.join(listed, "_row", "left").select(*kept, F.coalesce("_items", none).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, width: int = 13, slop: int = 0) -> DataFrame:
    """(doc_id, text, n_words, n_hit, spans, items) of every row of ``docs``; see ``matches``."""
    windows, owned = query_windows(items, width)
    return _with_items(matches(docs, windows, slop), owned, ["doc_id", "text", "n_words", "n_hit", "spans"])


def is_contaminated():
    """A document is contaminated if at least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def contamination_report(docs: DataFrame, items: DataFrame, width: int = 13) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of (doc_id, text)."""
    windows, owned = query_windows(items, width)
    narrow = matches(docs.select("doc_id", "text"), windows).select("doc_id", "n_words", "n_hit", "spans")
    found = _with_items(narrow, owned, ["doc_id", "n_words", "n_hit"])
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array("items")).cast("binary"), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 13) -> DataFrame:
    """``docs`` without the contaminated rows."""
    windows = query_windows(items, width)[0]
    return unpacked(matches(packed(docs), windows, rest=("_rest",)).filter(~is_contaminated()), docs.columns)
