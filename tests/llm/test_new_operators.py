"""Spelling variants, the manifest and the index of suffix arrays against brute force, and their defined cases."""

import hashlib
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from stayscope.llm import merkle, spelling, suffixindex  # noqa: E402
from stayscope.llm.queries import ORACLE, QUERIES, documents  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return [(r["doc_id"], r["text"]) for r in documents(spark, FOLDER).collect()]


# 11: spelling variants


def brute_words(docs, length=5, count=3):
    total = Counter()
    for i, t in docs:
        for run in re.findall("[a-zÀ-ÿ]+", (t or "").encode().lower().decode()):
            check = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if check % 97 == 0:
                run = run[: check % len(run)] + run[check % len(run) + 1 :]
            total[run] += len(run) >= length
    return {w: n for w, n in total.items() if n >= count}


def one_edit(word, letters):
    cut = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cut if b} | {a + c + b for a, b in cut for c in letters} | {a + c + b[1:] for a, b in cut if b for c in letters}
    return out - {word}


def brute_variants(words, ratio=2):
    letters = sorted({c for w in words for c in w})
    near = {w: [x for x in one_edit(w, letters) if x in words] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root


def variant_rows(df):
    return sorted(map(tuple, df.select("word", "n", "n_near", "form", "form_n", "root").collect()))


def test_op11_brute_force(spark, table):
    got = variant_rows(QUERIES["op11_spelling_variants"](spark, FOLDER))
    want = sorted(brute_variants(brute_words(table)))
    assert got == want and sum(x[3] is not None for x in want) > 20


@pytest.mark.parametrize("symbols", [2, 6])
def test_op11_dense_words(spark, symbols):
    rng = random.Random(11)
    words = {"".join(rng.choice("abcéÿ") for _ in range(rng.randint(1, 6))): rng.choice([3, 4, 6, 8, 12, 12, 30]) for _ in range(400)}
    words |= {"ab" * 60: 3, "ab" * 60 + "a": 9, "ab" * 59 + "bb": 20}
    got = spelling.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long"), symbols=symbols)
    assert variant_rows(got) == sorted(brute_variants(words))


def test_op11_neighbourhood_is_whole():
    rng = random.Random(5)
    for n in (1, 2, 5, 9):
        words = [bytes(rng.randrange(3) for _ in range(n)) for _ in range(20)]
        r = np.frombuffer(b"".join(words), np.uint8).reshape(20, n)
        got = Counter(x for rows, keys in spelling.neighbourhoods(r, 3) for x in zip(rows.tolist(), keys.tolist()))
        cut = lambda w: [(w[:i], w[i:]) for i in range(n + 1)]
        want = {i: {w} | {a + b[1:] for a, b in cut(w) if b} | {a + bytes([c]) + b for a, b in cut(w) for c in range(3)} | {a + bytes([c]) + b[1:] for a, b in cut(w) if b for c in range(3)} for i, w in enumerate(words)}
        assert got == Counter((i, spelling.reduced_key(x)) for i, found in want.items() for x in found)


def test_op11_long_words_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spelling, "_BLOCK", 500)
    long = "".join(random.Random(3).choice("abcdefgh") for _ in range(3000))
    docs = [(i, f"{long} {long[:1500]}{long[1501:]} hello {long}") for i in range(3)]
    got = {r["word"]: r for r in spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), slip=0).collect()}
    assert got[long[:1500] + long[1501:]]["form"] == long and got[long]["form"] is None and got[long]["n"] == 6


def test_op11_chain_of_forms(spark):
    words = {"x" * k: 4**k for k in range(1, 20)}
    got = {r["word"]: r["root"] for r in spelling.variant_groups(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert set(got.values()) == {"x" * 19}


def test_op11_odd(spark):
    schema = "doc_id long, text string, word string, n long, near string, root string"
    rows = [(None, None), (1, ""), (None, "Grüße grüße GRÜßE"), (2, "12 ÉCOLE École école\x00école x"), (2, "same words here"), (2, "same words here"), (2, "same words here")]
    df = spark.createDataFrame([(i, t, "word", 9, "x", "y") for i, t in rows], schema)
    got = {r["word"]: r["n"] for r in spelling.spelling_variants(df, least_count=1, slip=0).collect()}
    assert got == {"grüße": 2, "grÜße": 1, "École": 2, "école": 2, "words": 3}
    assert spelling.spelling_variants(df.limit(0)).count() == 0 and spelling.spelling_variants(df.filter("text IS NULL")).count() == 0


# 12: manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_tree(hashes, arity):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def brute_path(levels, place, arity):
    for level in levels[:-1]:
        a = place // arity * arity
        yield level[a:place], level[place + 1 : a + arity]
        place //= arity


def brute_manifest(rows, arity=3):
    """Of rows (doc_id, source, lang, n_chars, text)."""
    null_first = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (null_first(r[0]), brute_leaf(r)))
        trees[s] = brute_tree([brute_leaf(r) for r in groups[s]], arity)
    top = brute_tree([trees[s][-1][0] for s in order], arity)
    for k, s in enumerate(order):
        for place, r in enumerate(groups[s]):
            lost = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            node, proof = brute_leaf((*r[:4], r[4].replace("\n", "")) if lost else r), []
            for left, right in [*brute_path(trees[s], place, arity), *brute_path(top, k, arity)]:
                node = sha(*left, node, *right)
                proof += [*left, *right]
            root = top[-1][0]
            yield r[0], brute_leaf(r), trees[s][-1][0], root, sha(*proof), node, node == root


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def manifest_rows(df):
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_op12_sql_and_brute_force(spark):
    from oracle import connect, differences

    name = "op12_merkle_manifest"
    assert differences(spark, connect(FOLDER), name, QUERIES[name], ORACLE[name], FOLDER) == ""
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = manifest_rows(QUERIES[name](spark, FOLDER))
    assert got == sorted(brute_manifest(rows), key=str) and {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("arity,rows,levels", [(3, 7, 9), (3, 1, 2), (2, 10, 3), (5, 64, 1)])
def test_op12_leaf_partitions(spark, monkeypatch, arity, rows, levels):
    monkeypatch.setattr(merkle, "_LEVELS", levels)
    rng = random.Random(arity * rows)
    docs = [(i, rng.choice([None, "", "a", "a", "a", "é", "z", *map(str, range(9))]), None, 3, rng.choice([None, "a\nb", "x"])) for i in range(300)]
    docs += [(7, "a", "en", 1, "again\n")] * 40 + [(None, "a", "en", 1, "again\n")] * 3
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    assert manifest_rows(merkle.manifest_report(df, arity, rows)) == sorted(brute_manifest(docs, arity), key=str)


def test_op12_asks_for_nothing_it_can_derive(spark):
    for total in (1, 2, 9, 10, 28, 81, 100):
        for low in range(0, total, 5):
            n = min(9, total - low)
            asked = merkle.missing_nodes(spark.createDataFrame([(0, 0, 4, low, n, total)], "part int, chunk int, tree long, low long, n long, total long"), 3).collect()
            known, size, level, want = set(range(low, low + n)), total, 0, set()
            while size > 1:
                children = {c for p in {k // 3 for k in known} for c in range(3 * p, min(3 * p + 3, size))}
                want |= {(level, c) for c in children - known}
                known, size, level = {k // 3 for k in known}, -(-size // 3), level + 1
            assert sorted((r["level"], r["place"]) for r in asked) == sorted(want)


def test_op12_odd(spark):
    none = spark.createDataFrame([], DOCS)
    assert merkle.manifest_report(none).count() == 0
    one = [(1, None, None, None, None)]
    assert manifest_rows(merkle.manifest_report(spark.createDataFrame(one, DOCS))) == list(brute_manifest(one))
    long = [(2, "s", "en", 9, "word\n" * 100_000), (4, "s", "en", 9, "")]
    df = spark.createDataFrame([(*r, "tree", 9, "root") for r in long], DOCS + ", tree string, place int, leaf string")
    assert manifest_rows(merkle.manifest_report(df)) == sorted(brute_manifest(long), key=str)


# 13: suffix arrays


def brute_removed(docs, length):
    """Of (id, text) rows: removed flags of each row's bytes."""
    last = 2**63 - 1
    first = {}
    rows = [(last if i is None else i, (t or "").encode()) for i, t in docs]
    for i, t in rows:
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            first[w] = min(first.get(w, (i, s)), (i, s))
    for i, t in rows:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if first[t[s : s + length]] < (i, s):
                gone[s : s + length] = b"\1" * length
        yield t, gone


def brute_suffix_report(docs, length):
    for (i, _), (t, gone) in zip(docs, brute_removed(docs, length)):
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        yield i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()


def suffix_rows(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_op13_sql_and_brute_force(spark, table):
    from oracle import connect, differences

    name = "op13_suffix_array_dedup"
    assert differences(spark, connect(FOLDER), name, QUERIES[name], ORACLE[name], FOLDER) == ""
    got = suffix_rows(QUERIES[name](spark, FOLDER))
    assert got == sorted(brute_suffix_report(table, 100), key=str) and sum(r[2] for r in got) > 1000


def repeating_docs(n, seed=13):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abé \n") for _ in range(rng.randint(8, 60))) for _ in range(6)]
    return [(i, "".join(rng.choice([*passages, f"w{rng.randint(0, 30)}", "ab" * 9]) for _ in range(rng.randint(0, 12)))) for i in range(n)]


@pytest.mark.parametrize("group,batch,rows", [(4000, 20_000, 3000), (2, 40, 7), (30, 10, 1), (8, 100, 50)])
def test_op13_levels_and_salts(spark, group, batch, rows):
    docs = repeating_docs(90)
    size = suffixindex.Repeats(length=20, prefix=6, group=group, batch=batch, rows=rows)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert suffix_rows(suffixindex.repeat_report(df, size)) == sorted(brute_suffix_report(docs, 20), key=str)


def test_op13_family_merges_geometrically():
    rng = np.random.default_rng(1)
    family, seen, merged = suffixindex.SuffixArrays(4), set(), 0
    for _ in range(64):
        data = rng.integers(97, 100, 30).astype(np.uint8)
        window = family.windows(data, np.arange(27))
        ordered, at = np.unique(window, return_index=True)
        known = family.known(ordered)
        assert known.tolist() == [w in seen for w in ordered.tolist()]
        seen |= set(ordered.tolist())
        family.add(data, at[~known])
        merged = max(merged, len(family.levels))
        for text, starts in family.levels:
            level = family.windows(text, starts)
            assert (level[1:] > level[:-1]).all()
        sizes = [len(s) for _, s in family.levels]
        assert sum(sizes) == len(seen) and all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    assert merged > 1


def test_op13_long_texts_are_cut_with_overlap(spark, monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    docs = [(1, text), (2, "x" + text[500:3000]), (3, text * 2), (4, "a" * 500), (5, "ab" * 300)]
    monkeypatch.setattr(suffixindex, "_BLOCK", 301)
    size = suffixindex.Repeats(length=40, prefix=8)
    assert [x.tolist() for x in suffixindex.stretches([t.encode() for _, t in docs], size)[2:4]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert suffix_rows(suffixindex.repeat_report(df, size)) == sorted(brute_suffix_report(docs, 40), key=str)


def test_op13_hashes_in_blocks_of_a_core_s_cache(monkeypatch):
    rng, seen, plain = random.Random(3), [], suffixindex._prefix_hashes
    text = "".join(rng.choice("abcdefgh \n") for _ in range(150_000)).encode()
    texts = [b"", text, b"x" * 99, b"y" * 100, text[70_001:90_000] + text, b"", b"z" * 101]
    monkeypatch.setattr(suffixindex, "_prefix_hashes", lambda data, size: seen.append(len(data)) or plain(data, size))
    data, begin, of, place, n, key = suffixindex.stretches(texts, suffixindex.Repeats())
    assert max(seen) <= 1 << 17 and sum(seen) >= len(data)
    starts = np.concatenate([np.arange(a, a + k) for a, k in zip(place, n)])
    assert starts.tolist() == [begin[i] + k for i, t in enumerate(texts) for k in range(len(t) - 99)]
    assert (np.repeat(of, n) == np.searchsorted(begin, starts, "right") - 1).all()
    # equal windows have equal prefixes, wherever a block ends
    prefixes, each = {}, np.repeat(key, n).tolist()
    assert all(prefixes.setdefault(data[a : a + 100].tobytes(), k) == k for a, k in zip(starts.tolist(), each))


def test_op13_odd(spark):
    schema = "doc_id long, text string, id string, doc_key int, gone string, n_chars long, low long"
    long = "".join(random.Random(4).choice("abcdef ") for _ in range(300))
    docs = [(1, None), (2, ""), (3, "short"), (4, long), (4, long), (4, "x" + long), (5, long[:150] + "é" * 80 + long[150:]), (None, long), (None, "é" * 80), (None, long), (9, "\0" * 130), (10, "\0" * 50)]
    df = spark.createDataFrame([(i, t, "x", 1, "y", 0, 5) for i, t in docs], schema).repartition(3)
    assert suffix_rows(suffixindex.repeat_report(df)) == sorted(brute_suffix_report(docs, 100), key=str)
    out = suffixindex.drop_repeats(df)
    assert out.columns == df.columns and out.count() == len(docs)
    want = Counter((i, None if t is None else bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore")) for (i, t), (raw, gone) in zip(docs, brute_removed(docs, 100)))
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == want
    assert out.filter("n_chars <> length(text)").count() == 0
    assert suffixindex.repeat_report(df.limit(0)).count() == 0
