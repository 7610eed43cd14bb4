"""Spelling variants: words one edit apart, and the frequent form that each leads to.

Words are runs of letters, counted over all texts. Letters are hashed to a few
symbols; a reduced word is a word in symbols. An edit of a word is an edit of
its reduced word or leaves that as it is, so the full neighbourhood of a reduced
word (itself and all that one insertion, deletion or replacement makes of it)
holds the reduced words of everything near. Neighbourhoods are generated once per
distinct reduced word, as 64-bit keys, and meet the reduced vocabulary in one
equality join; only then do the words under both reduced words meet, and the
original strings decide.

A neighbourhood of a word of L letters has about 2 * symbols * L keys, written in
blocks of positions, so a very long word costs keys, not memory. Of two words that
meet, the parities of their letters must differ in two places at most, which
drops nearly all other pairs inside the join. Equal keys of unequal reduced words
only add pairs to verify.

A form has at least ``ratio`` > 1 times the count of its word, so chains of
forms end; they are followed by pointer jumping, in as many rounds as the
logarithm of the longest chain.

Defined cases: a null or empty text has no words; a null id counts as an empty
one in the checksum; repeated rows count each time; equal counts go to the least
word in code-point order; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayscope.llm.textarrays import map_slices, mix, powers, text_bytes
from stayscope.session import written_table

#: Runs of letters in text whose A-Z are lower-cased
_RUN = re.compile("[a-zÀ-ÿ]+")
_BASE = 0x5DEECE66D * 8 + 5
#: Keys made at once
_BLOCK = 1 << 20


def run_counts(docs: DataFrame, least_length: int = 5, slip: int = 97) -> DataFrame:
    """(word, n): letter runs of (doc_id, text) with their number.

    Where the checksum of id and run is a multiple of ``slip`` one letter of the
    run is left out, which plants misspellings; ``slip`` 0 leaves all as they are.
    """

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        total: Counter[str] = Counter()
        for doc, text in zip(part.column("doc_id").to_pylist(), text_bytes(part)):
            head = b"%d:" % doc if doc is not None else b":"
            for run, n in Counter(_RUN.findall(text.lower().decode("utf-8", "replace"))).items():
                if slip:
                    check = zlib.crc32(head + run.encode())
                    if check % slip == 0:
                        at = check % len(run)
                        run = run[:at] + run[at + 1 :]
                if len(run) >= least_length:
                    total[run] += n
        return pa.record_batch([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    return map_slices(docs.select("doc_id", "text"), rows, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def symbols_of(symbols: int) -> np.ndarray:
    """Symbol of each code point up to U+00FF."""
    return (mix(np.arange(256, dtype=np.uint64) + np.uint64(7)) % np.uint64(symbols)).astype(np.uint8)


def _keys(total: np.ndarray, length: int) -> np.ndarray:
    return mix(total + np.uint64(length * 0x9E3779B97F4A7C15 % 2**64))


def reduced_key(reduced: bytes) -> int:
    """Key of one reduced word."""
    r = np.frombuffer(reduced, np.uint8).astype(np.uint64)
    return int(_keys(((r + np.uint64(1)) * powers(_BASE, len(r))[: len(r)]).sum(keepdims=True), len(r))[0])


def neighbourhoods(r: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For reduced words of one length, a row each: (row, key) of each word and of all that one edit makes of it, in blocks of positions."""
    rows, n = r.shape
    r = r.astype(np.uint64)
    power = powers(_BASE, n + 2)
    before = np.zeros((rows, n + 1), np.uint64)
    np.cumsum((r + np.uint64(1)) * power[:n], axis=1, out=before[:, 1:])
    whole, every = before[:, n], np.arange(rows)
    yield every, _keys(whole, n)
    letters = np.arange(symbols, dtype=np.uint64)
    down, up = np.uint64(pow(_BASE, -1, 2**64)), np.uint64(_BASE)
    step = max(1, _BLOCK // (rows * (2 * symbols + 1)))
    for a in range(0, n, step):
        i = np.arange(a, min(a + step, n))
        here, left = r[:, i], before[:, i]
        # a letter between equal ones gives the same word whichever is taken or put before
        single = (i == n - 1) | (here != r[:, np.minimum(i + 1, n - 1)])
        yield np.nonzero(single)[0], _keys((left + (whole[:, None] - before[:, i + 1]) * down)[single], n - 1)
        other = letters != here[:, :, None]
        row = np.nonzero(other)[0]
        yield row, _keys((whole[:, None, None] + (letters - here[:, :, None]) * power[i, None])[other], n)
        put = left[:, :, None] + (letters + np.uint64(1)) * power[i, None] + ((whole[:, None] - left) * up)[:, :, None]
        yield row, _keys(put[other], n + 1)
    yield np.repeat(every, symbols), _keys((whole[:, None] + (letters + np.uint64(1)) * power[n]).ravel(), n + 1)


def reduce_words(words: DataFrame, symbols: int) -> DataFrame:
    """``words`` (word, ...) with ``reduced``, its ``key`` and ``parity``, a bit per letter modulo 64 that occurs an odd number of times."""
    table = symbols_of(symbols)

    def rows(batches):
        for part in batches:
            raw = [w.encode("latin-1") for w in part.column("word").to_pylist()]
            reduced = [table[np.frombuffer(w, np.uint8)].tobytes() for w in raw]
            key = [reduced_key(r) for r in reduced]
            parity = [int(np.bitwise_xor.reduce(np.uint64(1) << (np.frombuffer(w, np.uint8).astype(np.uint64) & np.uint64(63)))) for w in raw]
            made = [pa.array(reduced, pa.binary()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (key, parity))]
            yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), *made], ["word", "n", "reduced", "key", "parity"])

    return words.select("word", "n").mapInArrow(rows, "word string, n long, reduced binary, key long, parity long")


def near_pairs(words: DataFrame, symbols: int = 6) -> DataFrame:
    """(word, n, near, near_n): both directions of every two words of (word, n) that are exactly one edit apart.

    Words are distinct and of letters up to U+00FF.
    """
    known = written_table(reduce_words(words, symbols), "reduced-words")

    def reach(batches):
        for part in batches:
            reduced, key = part.column("reduced").to_pylist(), part.column("key").to_numpy()
            length = np.array([len(w) for w in reduced])
            for n in np.unique(length):
                same = np.flatnonzero(length == n)
                step = max(1, _BLOCK // (int(n) * (2 * symbols + 1)))
                for a in range(0, len(same), step):
                    own = same[a : a + step]
                    letters = np.frombuffer(b"".join([reduced[i] for i in own]), np.uint8).reshape(len(own), -1)
                    for row, near in neighbourhoods(letters, symbols):
                        yield pa.record_batch([pa.array(key[own][row]), pa.array(near.view(np.int64))], ["key", "near_key"])

    # one neighbourhood per distinct reduced word, whatever the number of its words
    edges = known.select("reduced", "key").distinct().mapInArrow(reach, "key long, near_key long")
    there = known.select(F.col("key").alias("near_key"), F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("parity").alias("near_parity"))
    both = edges.join(there, "near_key").join(known.select("key", "word", "n", "parity"), "key")
    close = both.filter((F.bit_count(F.col("parity").bitwiseXOR(F.col("near_parity"))) <= 2) & (F.col("word") != F.col("near")))
    # unequal reduced words of one key find their pairs twice
    return close.filter(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n").distinct()


def chain_ends(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): where the chain of forms from each word ends; there are no circles."""
    reach = written_table(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = reach.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("_moved"))
        moved = written_table(moved, "form-chains")
        reach = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return reach


def variant_groups(words: DataFrame, ratio: int = 2, symbols: int = 6) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of (word, n).

    ``form`` is the near word of the greatest count if that is at least ``ratio`` times the word's own.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words, or chains need not end")
    words = written_table(words.select("word", "n"), "vocabulary")
    pairs = near_pairs(words, symbols)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    each = pairs.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("_best"))
    enough = -F.col("_best.less") >= F.col("n") * ratio
    each = written_table(each.select("word", "n_near", F.when(enough, F.col("_best.near")).alias("form"), F.when(enough, -F.col("_best.less")).alias("form_n")), "near-words")
    ends = chain_ends(each.filter("form IS NOT NULL"))
    out = words.join(each, "word", "left").join(ends, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, slip: int = 97, ratio: int = 2, symbols: int = 6) -> DataFrame:
    """``variant_groups`` of the words of (doc_id, text) that have the least length and count."""
    return variant_groups(run_counts(docs, least_length, slip).filter(F.col("n") >= least_count), ratio, symbols)
