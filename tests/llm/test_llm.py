"""The operators against SQL, libraries or brute force, and their defined cases."""

import hashlib
import math
import random
import sys
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from oracle import connect, differences  # noqa: E402
from stayscope.llm import bpecount, decontamination, langid, linededup, ngram, orderminhash, pieces, sharding, simhash, substringdedup, textarrays, widesimhash  # noqa: E402
from stayscope.llm.queries import ORACLE, QUERIES, documents, tokenizer_file  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, fp long, hi string, drop int, range int, ghost string, score double, _id int"
ODD = [
    (1, None, None), (2, "", "en"), (3, "  \t\n\r ", "en"), (4, "12 + 34 = 46", "en"), (5, "Same line here\nother", "en"), (5, "Same line here\nother", "en"),
    (6, LONG, "en"), (7, "the cat sat on the mat and the dog ran", "en"), (8, "le chat est sur la table et le chien court", "fr"), (9, "La", None),
    (None, "no id at all", "fr"), (10, "the cat sat on the mat and the dog ran", "en"), (11, "日本語 😀 ▁ <|endoftext|> don't", None), (7, "another text of seven", "fr"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, x, 0, "a", 1, 2, "g", 0.5, 7) for i, t, x in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def table(spark):
    return [(r["doc_id"], r["text"]) for r in documents(spark, FOLDER).collect()]


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(spark, name):
    assert differences(spark, connect(FOLDER), name, QUERIES[name], ORACLE[name], FOLDER) == ""


# 1: language model


def brute_scores(docs, learn, score):
    tokens = lambda s: [*(s or "").encode().lower().split(), "</s>"]
    train = [tokens(t) for i, t in docs if learn(i)]
    count, pairs = Counter(w for x in train for w in x), Counter(p for x in train for p in zip(["<s>", *x], x))
    n, v = sum(count.values()), len(count)

    def discounts(c):
        k = Counter(c.values())
        if not (k[1] and k[2] and k[3]):
            return [0, 0.5, 1, 1.5]
        y = k[1] / (k[1] + 2 * k[2])
        found = [i - (i + 1) * y * k[i + 1] / k[i] for i in (1, 2, 3)]
        return [0, *(found if all(0 < x <= i for i, x in enumerate(found, 1)) else (0.5, 1, 1.5))]

    after = Counter(b for _, b in pairs)
    d, d0, total, rest = discounts(pairs), discounts(after), Counter(), defaultdict(float)
    for (a, _), c in pairs.items():
        total[a] += c
        rest[a] += d[min(3, c)]
    even = (sum(d0[min(3, c)] for c in after.values()) / len(pairs) if pairs else 1) / (v + 1)
    low = lambda w: max(after[w] - d0[min(3, after[w])], 0) / max(len(pairs), 1) + even
    high = lambda a, w: (max(pairs[a, w] - d[min(3, pairs[a, w])], 0) + rest[a] * low(w)) / total[a] if total[a] else low(w)
    for i, t in docs:
        x = tokens(t)
        yield len(x), sum(w in count for w in x), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x), sum(math.log10(high(a, w)) for a, w in zip(["<s>", *x], x))


def close(a, b):
    return abs(a - b) <= 1e-6 * max(1, abs(b))


def same_scores(got, want):
    order = lambda rows: sorted(rows, key=lambda x: (*x[:3], round(x[3], 4), round(x[4], 4)))
    got, want = order((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), order(want)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(close(a[k], b[k]) for a, b in zip(got, want) for k in (3, 4))


def test_op1_brute_force(spark, table):
    got = QUERIES["op1_lm_scoring"](spark, FOLDER).collect()
    same_scores(got, brute_scores(table, lambda i: zlib.crc32(str(i).encode()) % 7 != 2, None))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op1_hot_contexts_are_split(spark, monkeypatch):
    monkeypatch.setattr(ngram, "_SHARD_TOKENS", 40)
    docs = [(i, "the " + " the ".join(f"w{(i * 7 + k) % 50}" for k in range(20))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = ngram.train(df)
    assert len(model.hot) and model.hot_parts.max() > 1
    same_scores(ngram.score(df, model).collect(), brute_scores(docs, lambda i: True, None))
    model.delete()


def test_op1_odd(spark, odd, none):
    plain = [(i, t) for i, t, _ in ODD]
    model = ngram.train(odd)
    same_scores(ngram.score(odd.select("doc_id", "text", "fp"), model).collect(), brute_scores(plain, lambda i: True, None))
    assert ngram.score_held_out(none).count() == 0
    unlearned = ngram.score(odd.select("doc_id", "text"), ngram.train(none)).collect()
    assert all(r["score"] == 0 and r["n_known"] == 0 for r in unlearned)


def test_op1_repeated_corpus_has_no_impossible_text(spark):
    probes = ["a b c d", "d c b a", "x", "a q", ""]
    for corpus in (["a b c d", "c d e"] * 5, ["a b", "a c", "b c", "a a", "q r"], ["same"] * 7, [""] * 3):
        docs = list(enumerate(corpus))
        model = ngram.train(spark.createDataFrame(docs, "doc_id long, text string"))
        got = ngram.score(spark.createDataFrame([(i, t) for i, t in enumerate(probes)], "doc_id long, text string"), model).collect()
        assert all(math.isfinite(r["score"]) and r["score"] < 0 and math.isfinite(r["perplexity"]) for r in got)
        model.delete()


# 2: fingerprints


def test_op2_edits(spark, table):
    got = {r["doc_id"]: r for r in QUERIES["op2_document_fingerprints"](spark, FOLDER).collect()}
    order = sorted(table, reverse=True)
    for (i, t), (_, u) in zip(order, [*order[1:], order[0]]):
        h = len(t) // 2
        e = t[: len(t) - h] + u[:h]
        assert got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        own, new = (orderminhash.signatures([x.encode()])[0] for x in (t, e))
        assert got[i]["fingerprint"] == own.astype(">u4").tobytes().hex() and got[i]["near_edited"] == (own == new).mean()
    assert np.mean([r["near_edited"] for r in got.values()]) > 5 * np.mean([r["near_next"] for r in got.values()])


def test_op2_signature_by_brute_force():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (0, 1, 2, 3, 9, 40)]
    for t, sign in zip(texts, orderminhash.signatures([t.encode() for t in texts], k=2, take=2, tuples=8)):
        assert (sign == orderminhash.signatures([t.encode()], k=2, take=2, tuples=8)[0]).all()
    a = " ".join(f"w{i}" for i in range(200))
    moved = " ".join([*(f"w{i}" for i in range(100, 200)), *(f"w{i}" for i in range(100))])
    near = a.replace("w50 ", "x ")
    s = orderminhash.signatures([x.encode() for x in (a, moved, near)], tuples=256)
    # order matters: the moved text has nearly all k-mers and still falls behind
    assert (s[0] == s[2]).mean() > 0.9 > 0.8 > (s[0] == s[1]).mean() > 0.2
    assert (orderminhash.signatures([b"a a a a"])[0] != orderminhash.signatures([b"a a"])[0]).any()


def test_op2_odd(spark, odd, none):
    got = orderminhash.fingerprints(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r["near_next"] <= 1 for r in got)
    assert {r["n_chars"] for r in got if r["doc_id"] == 6} == {len(LONG)}
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert orderminhash.fingerprints(none).count() == 0
    one = spark.createDataFrame([(4, "one text only")], "doc_id long, text string")
    assert orderminhash.fingerprints(one).first()["near_next"] == 1.0


@pytest.mark.parametrize("hot", [None, 7])
def test_op2_rows_of_one_id_or_none_are_spread(spark, hot):
    rows = [(hot, f"text of row {i} " + "word " * (i % 7)) for i in range(500)] + [(i, f"named text {i}") for i in range(20) if i != hot]
    keyed = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("doc_id", "text", f"coalesce(doc_id, {-(2**63)}) AS rank", "xxhash64(text) AS hash")
    placed = orderminhash._in_ranges(keyed, 8, sum(len(t) + 1 for _, t in rows)).collect()
    count = Counter(r["range"] for r in placed)
    assert len(placed) - len(rows) == len(count) == 8 and max(count.values()) < 2 * len(rows) / 8
    got = orderminhash.fingerprints(keyed.select("doc_id", "text")).collect()
    order = sorted(map(tuple, keyed.select("rank", "hash", "text").collect()), reverse=True)
    want = Counter()
    for (rank, _, t), (*_, u) in zip(order, [*order[1:], order[0]]):
        want[None if rank == -(2**63) else rank, hashlib.sha256(orderminhash.edited(t, u).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want


def test_op2_rows_alike_are_copied_once_a_task(spark):
    docs = spark.createDataFrame([(5, "the same text here")] * 300 + [(i, f"text {i}") for i in range(5)], "doc_id long, text string").repartition(4)
    keyed = docs.selectExpr("doc_id", "text", "doc_id AS rank", "xxhash64(text) AS hash")
    assert orderminhash._in_ranges(keyed, 8, 7000).filter("ghost").count() <= 4 * 8
    got = orderminhash.fingerprints(docs).collect()
    assert len(got) == 305 and Counter(r["near_next"] == 1.0 for r in got if r["doc_id"] == 5) == {True: 299, False: 1}


# 3: decontamination


def test_op3_odd(spark, odd, none):
    items = spark.createDataFrame([("a", "Cat sat, ON the mat"), ("b", None), ("c", "..."), ("d", "zebra crossing"), (None, "table et")], "item_id string, text string")
    got = {(r["doc_id"], r["text"]): r for r in decontamination.contamination(odd, items, 4).collect()}
    hit = got[7, ODD[7][1]]
    assert (hit["n_words"], hit["n_hit"], hit["items"]) == (10, 5, ["a"]) and len(hit["spans"]) == 2
    assert got[8, ODD[8][1]]["n_hit"] == 2 and got[8, ODD[8][1]]["items"] == []
    assert got[1, None]["n_words"] == 0 and len(got) == len(set((i, t) for i, t, _ in ODD))
    unnamed = decontamination.contamination(odd, items.unionByName(spark.createDataFrame([("e", "no ID at")], items.schema)), 4).filter("doc_id IS NULL").first()
    assert (unnamed["n_words"], unnamed["n_hit"], unnamed["items"]) == (4, 3, ["e"])
    assert decontamination.contamination_report(none, items).count() == 0
    assert decontamination.contamination_report(odd, items.filter("false")).filter("n_hit > 0").count() == 0
    assert decontamination.drop_contaminated(odd, items, 4).columns == odd.columns


def test_op3_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha " + "z " * 9 + "beta gamma")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "alpha beta gamma")], "item_id string, text string")
    near = {r["doc_id"]: r["n_hit"] for r in decontamination.contamination(docs, items, 3, slop=2).collect()}
    assert near == {1: 5, 2: 3, 3: 0}


def test_op3_one_passage_in_many_items(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    items = spark.createDataFrame([(f"i{k:03d}", f"{passage} own{k}") for k in range(300)] + [("i000", passage), (None, passage), ("z", "p1 p2 p3 p4")], "item_id string, text string")
    docs = spark.createDataFrame([(d, f"head{d} {passage} own{d} tail") for d in range(200)], "doc_id long, text string")
    windows, owned = decontamination.query_windows(items, 13)
    # 18 shared windows, one of each item, one of four words
    assert windows.count() == 18 + 300 + 1 and owned.count() == 300 + 300 + 1
    index, _ = decontamination.build_index(docs)
    assert decontamination.candidates(index, windows).count() == 200 * 18 + 200 + 200
    got = decontamination.contamination(docs, items).collect()
    everyone = [f"i{k:03d}" for k in range(300)] + ["z"]
    assert len(got) == 200 and all(r["items"] == everyone and r["n_hit"] == 31 and len(r["spans"]) == 20 for r in got)
    digest = hashlib.sha256(",".join(everyone).encode()).hexdigest()
    assert {tuple(r)[2:] for r in decontamination.contamination_report(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()} == {(31, 301, digest, True)}


def test_op3_terms_come_in_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "_TERMS_A_ROW", 2)
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(40)) for _ in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(str(i), " ".join(texts[i].split()[3:6]) if i % 2 else f"x{i} y{i} z{i}") for i in range(400)], "item_id string, text string")
    terms = items.selectExpr("explode(split(text, ' ')) AS w").selectExpr("xxhash64(w) AS term")
    sizes = [len(r["wanted"]) for r in decontamination._by_bucket(terms).collect()]
    assert max(sizes) <= 16 and sum(sizes) == terms.distinct().count()
    want = {i: sorted(r["item_id"] for r in items.collect() if f" {r['text']} " in f" {t} ") for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["items"] for r in decontamination.contamination(docs, items, 3).collect()} == want


# 4: token counts


def test_op4_library(spark, table):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    rng, pool = random.Random(3), "abcst'  \n\t.,!12é日😀reveldm  S'’ÉàaaaaẞⅣ²\x1c\x85"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    texts += [t for _, t in table] + ["", "a<|endoftext|>b", "<|endoftext|>", "a" * 4000, "don't we're I'll 'still 's ''s x'S", " " * 50, "x\n\n 'll", LONG]
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert bpecount.loaded(tokenizer_file("byte_bpe_50k.json")).count(texts).tolist() == want


def test_op4_odd(odd, none):
    path = tokenizer_file("byte_bpe_50k.json")
    got = {r["doc_id"]: r for r in bpecount.token_counts(odd, path).collect()}
    assert (got[1]["n_bytes"], got[1]["n_tokens"], got[2]["n_tokens"], got[6]["over_limit"]) == (0, 0, 0, True)
    assert bpecount.token_counts(none, path).count() == 0


# 5: SentencePiece


def test_op5_library(table):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = tokenizer_file("piece_bpe_32k.model")
    model, proto = pieces.Model(path), pb.ModelProto()
    proto.ParseFromString(Path(path).read_bytes())
    proto.trainer_spec.model_type = 1  # the library's Viterbi over the same pieces and scores
    lib, merged = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString()), sentencepiece.SentencePieceProcessor(model_file=path)
    score = lambda ids: sum(lib.get_score(int(i)) for i in ids)
    words = sorted({w for _, t in table for w in t.split()})[:4000]
    ours, theirs = [model.encode(w) for w in words], lib.encode(words)
    assert all(score(a) >= score(b) for a, b in zip(ours, theirs))
    assert np.mean([a.tolist() == b for a, b in zip(ours, theirs)]) > 0.98
    for _, t in table:
        assert model.decode(model.encode(t).tolist()) == t
        ids = merged.encode(t)
        assert model.decode(ids) == merged.decode(ids)


def test_op5_best_path_by_brute_force():
    model = pieces.Model(tokenizer_file("piece_bpe_32k.model"))
    known = {w: s for w, (_, _, s) in model.find.items()}
    ids = {i: s for _, (_, i, s) in model.find.items()}
    rng = random.Random(4)
    for _ in range(300):
        part = "▁" + "".join(rng.choice("theinagor") for _ in range(rng.randint(1, 9)))
        best = [0.0] + [-math.inf] * len(part)
        for e in range(1, len(part) + 1):
            best[e] = max(best[s] + known.get(part[s:e], -math.inf) for s in range(e))
        assert sum(ids[i] for i in np.frombuffer(model.path(part), np.int32)) == best[-1]


def test_op5_odd(odd, none):
    path = tokenizer_file("piece_bpe_32k.model")
    got = {r["doc_id"]: r for r in pieces.encoding_report(odd, path).collect()}
    assert got[1]["n_pieces"] == 0 and got[6]["round_trip"] and not got[11]["round_trip"] and got[11]["n_fallback"] == 0 or got[11]["n_fallback"] > 0
    back = pieces.decode_ids(pieces.encode_texts(odd.select("doc_id", "text"), path), path)
    assert {(r["doc_id"], r["text"]) for r in back.collect()} == {(i, (t or "").replace("▁", " ")) for i, t, _ in ODD}
    assert pieces.encoding_report(none, path).count() == 0


# 6: SimHash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints, linked):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if linked(i, j):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(prints))]


def test_op6_brute_force(spark, table):
    table = sorted(table)
    prints = [brute_fingerprint(t) for _, t in table]
    roots = brute_components(prints, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    got = {r["doc_id"]: r for r in QUERIES["op6_simhash"](spark, FOLDER).collect()}
    assert [(got[i]["fingerprint"], got[i]["component_id"]) for i, _ in table] == [(f"{p:016x}", table[r][0]) for p, r in zip(prints, roots)]
    assert len(set(roots)) < len(roots)


@pytest.mark.parametrize("bucket", [3, 20_000])
def test_op6_links(spark, bucket):
    rng = random.Random(6)
    prints = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(25):
            prints.add(x)
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
    prints = sorted(prints, key=lambda x: x - (1 << 64) if x >> 63 else x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    roots = brute_components(prints, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket=bucket)
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert [got.get(x, x) for x in signed] == [signed[r] for r in roots]


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[i] == 100 for i in range(101, 160))


def test_op6_odd(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {(r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] in (1, 2, 3)} == {("0" * 16, 1)}
    assert {r["component_id"] for r in got if r["doc_id"] == 10} == {7}
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id in (2, 3, 10)").count() == 0 and kept.filter("doc_id = 1").count() == 1


def test_op6_keep_one_row_of_each_component(spark):
    a, b, c = ("alpha beta gamma delta one two", "rain falls on quiet hills today", "ships sail west before the storm")
    rows = [(1, a, "x"), (1, a, "x"), (1, b, "x"), (2, b, "x"), (3, a, "x"), (None, c, "x"), (None, c, "x"), (None, a, "x"), (None, b, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    kept = [tuple(r) for r in simhash.keep_one(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, a, "x"), (1, b, "x"), (None, c, "x")], key=str)


# 6, at a similarity of shingles


def five_words(text):
    found = text.encode().lower().split()
    return {tuple(found[k : k + 5]) for k in range(max(1, len(found) - 4))} if found else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_wide_fingerprint_of_each_bit():
    texts = ["", "One two", "one  TWO", "a b c d e f g", "a b c d e a b c d e"]
    sets = widesimhash.shingle_sets([x.encode() for x in texts], 5)
    assert [len(x) for x in sets] == [len(five_words(x)) for x in texts] and (sets[1] == sets[2]).all()
    got = widesimhash.fingerprint_matrix([x.encode() for x in texts], 5, 3)
    mask = 2**64 - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    for row, hashes in zip(got, sets):
        for j, value in enumerate(row.tolist()):
            step = mixed((j + 1) * 0x9E3779B97F4A7C15 & mask)
            each = [mixed(int(h) ^ step) for h in hashes]
            assert value == sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in each) > len(each))


def test_wide_variants_keep_four_groups():
    cut = widesimhash.shape(1000)
    fps = np.random.default_rng(5).integers(0, 2**63, (3, cut.longs)).astype(np.uint64)
    keys = widesimhash.variant_keys(fps, cut)
    g = cut.group_bits
    for row, got in zip(fps, keys.tolist()):
        whole = sum(int(x) << 64 * k for k, x in enumerate(row))
        for s in range(cut.segments):
            groups = [whole >> g * (5 * s + k) & (1 << g) - 1 for k in range(5)]
            for wild in range(5):
                rest = groups[:wild] + groups[wild + 1 :]
                assert got[5 * s + wild] == (5 * s + wild << 4 * g) + sum(x << g * k for k, x in enumerate(rest))


def test_wide_shape_follows_the_rows():
    sizes = [widesimhash.shape(n) for n in (0, 1, 10**6, 10**9, 10**11)]
    assert sizes[0] == sizes[2] and sizes[2].group_bits < sizes[3].group_bits < sizes[4].group_bits
    assert all(s.limit < 64 * s.longs / 4 and s.segments * 5 * s.group_bits <= 64 * s.longs for s in sizes)


def test_wide_simhash_recall_and_precision(spark):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(4000)]
    draw = lambda n: [vocabulary[k] for k in rng.integers(0, len(vocabulary), n)]
    rows, planted = [], []
    for pair in range(240):
        size = (60, 150, 400)[pair % 3]
        one, other = draw(size), None
        near = rng.uniform(0.4, 0.6) if pair % 4 == 0 else rng.uniform(0.8, 0.99)
        other = list(one)
        changed = list(other)
        while True:
            changed[rng.integers(size)] = vocabulary[rng.integers(len(vocabulary))]
            if jaccard(five_words(" ".join(one)), five_words(" ".join(changed))) < near:
                break
            other = list(changed)
        planted.append((2 * pair, 2 * pair + 1, jaccard(five_words(" ".join(one)), five_words(" ".join(other)))))
        rows += [(2 * pair, " ".join(one)), (2 * pair + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = {r["doc_id"] for r in widesimhash.keep_one(docs).collect()}
    assert all(a in kept for a, _, _ in planted)
    gone = [b not in kept for _, b, j in planted if j >= 0.8]
    assert len(gone) > 150 and sum(gone) >= 0.95 * len(gone)
    assert all(b in kept for _, b, j in planted if j < 0.6)


def test_wide_simhash_of_one_large_group(spark):
    rng = np.random.default_rng(13)
    base = [f"w{k}" for k in rng.integers(0, 5000, 400)]
    rows = []
    for i in range(1500):
        changed = list(base)
        for k in rng.integers(0, 400, 3):
            changed[k] = f"x{i}"
        rows.append((i + 100, " ".join(changed)))
    rows += [(i, " ".join(f"y{k}" for k in rng.integers(0, 5000, 80))) for i in range(50)]
    kept = sorted(r["doc_id"] for r in widesimhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect())
    assert kept == [*range(50), 100]


def test_wide_simhash_links_of_rows_held_in_their_batch(spark, monkeypatch):
    """Only one row of a large group goes on from its batch; another of the group alone has the link to the next batch."""
    rng = np.random.default_rng(17)
    cut = widesimhash.shape(1000)
    width = 64 * cut.longs
    segment = lambda s, n, low, high: 25 * s + 5 * rng.permutation(5)[:n] + rng.integers(low, high, n)

    def flipped(bits, places):
        out = bits.copy()
        out[places] ^= 1
        return out

    assert cut.group_bits == 5 and cut.limit < 120
    batches = [[], []]
    for group in range(3):
        base = rng.integers(0, 2, width).astype(np.uint8)
        # all of a group share the variants of segment 0; ``far`` shares no other with ``bridge``, and is beyond the limit for the rest
        bridge = flipped(base, np.concatenate([segment(s, 4, 0, 2) for s in range(1, 23)]))
        far = flipped(bridge, np.concatenate([segment(s, 4, 2, 5) for s in range(1, 23)]))
        batches[0] += [*(flipped(base, segment(1 + k % 22, 2, 0, 5)) for k in range(40)), bridge]
        # a second crowd holds the partner back, too
        batches[1] += [far, *(flipped(far, segment(1 + k % 22, 2, 0, 5)) for k in range(40 if group else 0))]
    rows = [(1000 * b + i, np.packbits(x, bitorder="little").tobytes()) for b, batch in enumerate(batches) for i, x in enumerate(batch)]
    parts = [[r for r in rows if r[0] // 1000 == b] for b in (0, 1)]
    nodes = spark.createDataFrame(spark.sparkContext.parallelize(parts, 2).flatMap(list), "node long, fp binary")
    prints = np.array([np.frombuffer(x, "<u8") for _, x in rows])
    keys, ids = widesimhash.variant_keys(prints, cut), np.array([i for i, _ in rows])
    differ = np.bitwise_count(prints[:, None] ^ prints[None])
    sketch = np.where(np.arange(keys.shape[1]) < cut.segments // 2 * 5, differ[:, :, -1:], differ[:, :, :1])
    near = (differ.sum(axis=2) <= cut.limit) & ((keys[:, None] == keys[None]) & (sketch <= 20)).any(axis=2)
    across = [(a, b) for a, b in zip(*np.nonzero(near)) if ids[a] < 1000 <= ids[b]]
    assert across and all(ids[a] % 41 == 40 for a, _ in across)
    want = brute_components(prints, lambda i, j: near[i, j])
    for block in (2000, 7):
        monkeypatch.setattr(widesimhash, "_BLOCK", block)
        edges = [(r["a"], r["b"]) for r in widesimhash.links(nodes, cut).collect()]
        at = {i: k for k, i in enumerate(ids.tolist())}
        assert all(differ[at[a], at[b]].sum() <= cut.limit for a, b in edges)
        joined = {frozenset((at[a], at[b])) for a, b in edges}
        assert brute_components(prints, lambda i, j: frozenset((i, j)) in joined) == want and len(set(want)) == 3


def test_wide_simhash_odd(spark, odd, none):
    kept = widesimhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id in (2, 3, 10)").count() == 0 and kept.filter("doc_id = 1").count() == 1
    assert widesimhash.keep_one(none).count() == 0 and widesimhash.keep_one(none).columns == none.columns
    a, b, c = ("alpha beta gamma delta one two", "rain falls on quiet hills today", "ships sail west before the storm")
    rows = [(1, a, "x"), (1, a, "x"), (1, b, "x"), (2, b, "x"), (3, a, "x"), (None, c, "x"), (None, c, "x"), (None, a, "x"), (None, b, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = [tuple(r) for r in widesimhash.keep_one(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, a, "x"), (1, b, "x"), (None, c, "x")], key=str)
    clash = spark.createDataFrame([(1, a, 5, 6), (2, a, 5, 6), (3, c, 5, 6)], "doc_id int, text string, node int, fp int")
    assert sorted(tuple(r) for r in widesimhash.keep_one(clash).collect()) == [(1, a, 5, 6), (3, c, 5, 6)]


# 7: lines


def test_op7_odd(spark, odd, none):
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in linededup.line_report(odd, min_docs=1).collect()}
    assert {(1, 1, 0), (2, 1, 0), (3, 2, 0), (5, 2, 2), (7, 1, 1)} <= got
    out = linededup.drop_common_lines(odd, min_docs=2)
    assert out.columns == odd.columns
    # a repeated row is one document for the count
    assert {r["text"] for r in out.filter("doc_id = 5").collect()} == {"Same line here\nother"}
    assert {r["text"] for r in out.filter("doc_id = 10").collect()} == {""}
    assert out.filter("text IS NULL").count() == 1 and linededup.line_report(none).count() == 0


def test_op7_each_null_id_is_a_document(spark):
    docs = spark.createDataFrame([(None, f"shared\nown {i}") for i in range(3)] + [(None, "twice\ntwice"), (1, "mixed"), (None, "mixed"), (1, "mixed"), (None, "mixed")], "doc_id long, text string")
    got = sorted(r["text"] for r in linededup.drop_common_lines(docs.repartition(3), min_docs=3).collect())
    assert got == ["", "", "", "", "own 0", "own 1", "own 2", "twice\ntwice"]


# 8: shards


def check_shards(rows, shards):
    seen = defaultdict(list)
    for r in rows:
        seen[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in seen.values()) and set(seen) <= set(range(shards))


def test_op8_shards(spark, table):
    rows = QUERIES["op8_sharding"](spark, FOLDER).collect()
    check_shards(rows, 8)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in table)
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    assert len(size) == 8 and max(size.values()) - min(size.values()) <= 2 * max(r["size"] for r in rows)


def test_op8_small_groups_stay_whole(spark):
    docs = spark.createDataFrame([(i, f"text number {i // 3}") for i in range(6000)], "doc_id long, text string")
    rows = sharding.shard_table(docs, 8).collect()
    check_shards(rows, 8)
    where = defaultdict(set)
    for r in rows:
        where[r["doc_id"] // 3].add(r["shard"])
    assert all(len(x) == 1 for x in where.values())


def test_op8_hot_group_is_cut(spark):
    docs = spark.createDataFrame([(i, "same text over and over" if i % 2 else f"text number {i}") for i in range(8000)], "doc_id long, text string")
    rows = sharding.shard_table(docs, 8, ranges=64, sample=4000).collect()
    check_shards(rows, 8)
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    assert max(size.values()) < 1.03 * min(size.values())


@pytest.mark.parametrize("row", [(7, "one row over and over"), (None, "one row over and over"), (None, None)])
def test_op8_repeated_rows_are_cut(spark, row):
    docs = [row if i % 2 else (i, f"text number {i}") for i in range(8000)]
    rows = sharding.shard_table(spark.createDataFrame(docs, "doc_id long, text string"), 8, ranges=64, sample=4000).collect()
    check_shards(rows, 8)
    size = Counter()
    for r in rows:
        size[r["shard"]] += r["size"]
    assert len(size) == 8 and max(size.values()) < 1.03 * min(size.values())


def test_op8_odd(spark, odd, none, tmp_path):
    rows = sharding.shard_table(odd).collect()
    check_shards(rows, 8)
    assert len(rows) == len(ODD) and {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (1, 2)} == {(1, 0)}
    assert sharding.shard_table(none).count() == 0
    sharding.write_shards(odd, str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ODD)


# 9: language


def test_op9_held_out_accuracy(spark):
    rows = QUERIES["op9_language_id"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_op9_codewords():
    code = langid.codewords(7, 15)
    assert min((a != b).sum() for a, b in combinations(code, 2)) >= 5 and (abs(code.sum(axis=0)) < 7).all()


def test_op9_odd(odd, none):
    got = {(r["doc_id"], r["text"]): r for r in langid.predict(odd.select("doc_id", "text"), langid.fit(odd)).collect()}
    assert all(got[i, ODD[k][1]]["lang_pred"] == "und" for k, i in enumerate((1, 2, 3, 4)))
    assert got[8, ODD[8][1]]["lang_pred"] == "fr" and got[6, LONG]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.identify(none).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd.select("text"), langid.fit(none)).collect()} == {"und"}
    kept = langid.known_language(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {5, 6, 7, 8, 9, 10} and kept.filter("doc_id < 5").count() == 0


def test_op9_bound_holds_without_ids(spark, monkeypatch):
    name = [a + b + c for a in "abcdefghij" for b in "klmnopqrs" for c in "tuvwxyzabc"]  # features are of letters
    en = [(None, f"the cat {x} sat on the mat", "en") for x in name] + [(None, "the same row again", "en")] * 300
    fr = [(5, f"le chat {x} est sur la table", "fr") for x in name]
    seen = []
    monkeypatch.setattr(langid, "fit_features", lambda x, labels, *rest: seen.append((x, labels)))
    langid.fit(spark.createDataFrame(en + fr, "doc_id long, text string, lang string").repartition(4), max_rows=100)
    (x, labels), = seen
    count = Counter(labels)
    assert len(labels) <= 100 and all(20 <= count[k] <= 50 for k in ("en", "fr"))
    assert len({v.tobytes() for v in x}) >= len(x) - 1


# 10: substrings


def brute_repeats(docs, window):
    first = {}
    for i, t in docs:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    for i, t in docs:
        w = (t or "").encode().split()
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(window)}
        yield i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()


@pytest.mark.parametrize("group", [2, 20_000])
def test_op10_brute_force(spark, group):
    rng = random.Random(10)
    passages = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(8, 30))) for _ in range(6)]
    docs = [(i, " ".join(rng.choice([*passages, f"w{rng.randint(0, 30)}", "x y"]) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = substringdedup.repeat_report(df, substringdedup.Repeats(window=10, prefix=3, group=group))
    assert sorted(map(tuple, got.collect())) == sorted(brute_repeats(docs, 10))
    assert got.filter("n_removed > 0").count() > 10


def _passages(seed, copies):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(8, 30))) for _ in range(6)]
    docs = [(i, " ".join(rng.choice([*passages, f"w{rng.randint(0, 30)}", "x y"]) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    return docs + [(100 + i, docs[7][1] + (f" end{i}" if i % 2 else "")) for i in range(copies)]


@pytest.mark.parametrize("group", [0, 150, 1000, 2 << 20])
def test_op10_prefixes_of_all_lengths(spark, group):
    # groups that do not fit take prefixes of 5, 7 and 10 words; a third of the rows are copies
    docs = _passages(11, 30)
    size = substringdedup.Repeats(window=10, prefix=3, longer=(5, 7), group=group)
    got = substringdedup.repeat_report(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), size)
    assert sorted(map(tuple, got.collect())) == sorted(brute_repeats(docs, 10))


@pytest.mark.parametrize("group", [150, 2 << 20])
def test_op10_maximal_repeats(spark, group):
    docs = _passages(12, 10)
    size = substringdedup.Repeats(window=10, prefix=3, longer=(5, 7), group=group)
    found = substringdedup.maximal_repeats(spark.createDataFrame(docs, "doc_id long, text string"), size).collect()
    text = {i: t.split() for i, t in docs}
    occurs = lambda run: [i for i, w in text.items() for k in range(len(w) - len(run) + 1) if w[k : k + len(run)] == run]
    listed = set()
    for r in found:
        run = text[r["doc_id"]][r["place"] : r["place"] + r["n_words"]]
        where = occurs(run)
        assert len(run) == r["n_words"] >= 10
        if group > 150:
            assert (r["doc_id"], r["n"], r["n_docs"]) == (min(where), len(where), len(set(where)))
        else:
            assert 2 <= r["n_docs"] <= len(set(where)) and r["n"] <= len(where)
        listed |= {tuple(run[k : k + 10]) for k in range(len(run) - 9)}
    holders = {}
    for i, w in text.items():
        for k in range(len(w) - 9):
            holders.setdefault(tuple(w[k : k + 10]), set()).add(i)
    assert listed == {w for w, ids in holders.items() if len(ids) > 1}


def test_op10_suffix_tree():
    tree = substringdedup._Tree([b"x a b c d y", b"z a b c d w a b c", b"a b c"], 2)
    word = "x a b c d y $ z a b c d w a b c $ a b c $".split()
    nodes = {(depth, " ".join(word[tree.place[i] : tree.place[i] + depth]), j - i) for depth, i, j in tree.deep_nodes(2)}
    assert nodes == {(4, "a b c d", 2), (3, "a b c", 4)}


def test_op10_odd(odd, none, spark):
    got = substringdedup.repeat_report(odd, substringdedup.Repeats(window=5, prefix=2)).collect()
    assert len(got) == len(ODD) and {r["n_removed"] for r in got if r["doc_id"] == 10} == {10} and {r["n_removed"] for r in got if r["doc_id"] != 10} == {0}
    assert substringdedup.repeat_report(none).count() == 0
    copies = spark.createDataFrame([(1, LONG), (2, LONG)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substringdedup.repeat_report(copies).collect()} == {1: 0, 2: 60_000}


# the pipeline and the helpers


def test_pipeline_by_brute_force(spark, table):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    passed = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, FOLDER).collect()}
    texts = {i: t for i, t in table if i in passed}
    assert len(texts) >= 0.99 * len(table)
    key = lambda x: x.strip("\t\n\v\f\r ").encode().lower()
    often = Counter(k for t in texts.values() for k in {key(x) for x in t.split("\n")} if k)
    texts = {i: "\n".join(x for x in t.split("\n") if often[key(x)] < 10) for i, t in texts.items()}
    order = sorted(texts)
    # near copies: every pair of fingerprints is compared
    cut = widesimhash.shape(len(order))
    prints = widesimhash.fingerprint_matrix([texts[i].encode() for i in order], 5, cut.longs)
    variants = widesimhash.variant_keys(prints, cut)
    upper = np.arange(variants.shape[1]) < cut.segments // 2 * 5

    def near(i, j):
        differ = np.bitwise_count(prints[i] ^ prints[j])
        shared = variants[i] == variants[j]
        return differ.sum() <= cut.limit and (shared & (np.where(upper, differ[-1], differ[0]) <= 20)).any()

    roots = brute_components(prints, near)
    texts = {i: texts[i] for k, i in enumerate(order) if roots[k] == k}
    import regex

    words = lambda t: regex.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower())
    items = [words(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 13]) for w in items if w for k in range(max(1, len(w) - 12))}
    sizes = {len(w) for w in windows}

    def clean(t):
        w = words(t)
        hit = {k + j for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(n)}
        return not hit or 20 * len(hit) < len(w)

    texts = {i: t for i, t in texts.items() if clean(t)}
    model = pieces.Model(tokenizer_file("piece_bpe_32k.model"))
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == {i: model.encode(t).tolist() for i, t in texts.items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "benchmarks", "encode"]


def test_pipeline_decodes_its_ids(spark, odd):
    import corpus_pipeline

    model = pieces.Model(tokenizer_file("piece_bpe_32k.model"))
    docs = odd.withColumnRenamed("hi", "source")
    texts = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = corpus_pipeline.encode(spark, docs, FOLDER).collect()
    back = [model.decode(list(r["ids"])) for r in got]
    assert [r["decoded_sha256"] for r in got] == [hashlib.sha256(x.encode()).hexdigest() for x in back]
    assert Counter((r["doc_id"], x) for r, x in zip(got, back) if r["round_trip"]) <= texts
    assert all(r["round_trip"] == ((r["doc_id"], x) in texts) for r, x in zip(got, back))


def test_range_hash_is_free_of_place():
    data, _ = textarrays.joined([b"ab cd ab", b"cd ab"])
    start, end = textarrays.words(data, textarrays.NOT_SPACE)
    h = textarrays.range_hash(data, start, end)
    assert h[0] == h[2] == h[4] and h[1] == h[3] != h[0]


def thue_morse(n, swap=False):
    """The two strings of n bytes that collide under every polynomial modulo 2**64 from 1,024 bytes on."""
    return bytes(b"ab"[(i.bit_count() + swap) % 2] for i in range(n)).decode()


@pytest.mark.parametrize("n", [64, 512, 513, 1024, 2048, 8192])
def test_range_hash_of_structured_strings(n):
    data, begin = textarrays.joined([thue_morse(n).encode(), thue_morse(n, True).encode()])
    for seed in (1, 11, 12, 21, 31, 41, 51, 61):
        one, other = textarrays.range_hash(data, begin[:2], begin[1:] - 1, seed)
        assert one != other
        assert one >> np.uint64(32) != other >> np.uint64(32) and one & np.uint64(2**32 - 1) != other & np.uint64(2**32 - 1)


def test_range_hash_tells_all_short_ranges_apart():
    texts = [bytes([a, b])[:n] for n in (1, 2) for a in range(97, 123) for b in range(97, 123)] + [b"x" * n for n in range(1, 40)] + [b"x" * n + b"\0" for n in range(1, 40)]
    texts = sorted(set(texts))
    data, begin = textarrays.joined(texts)
    assert len(set(textarrays.range_hash(data, begin[:-1], begin[1:] - 1).tolist())) == len(texts)


def test_long_words_and_lines_are_told_apart(spark):
    a, b = thue_morse(1024), thue_morse(1024, True)
    docs = spark.createDataFrame([(i, a if i < 5 else b) for i in range(10)], "doc_id long, text string")
    assert linededup.line_report(docs, min_docs=10).filter("n_dropped > 0").count() == 0
    tail = " ".join(f"w{i}" for i in range(49))
    pair = spark.createDataFrame([(1, f"{a} {tail}"), (2, f"{b} {tail}")], "doc_id long, text string")
    assert substringdedup.repeat_report(pair).filter("n_removed > 0").count() == 0
    items = spark.createDataFrame([("i", a)], "item_id string, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontamination.contamination_report(docs, items, width=13).collect()}
    assert got == {i: i < 5 for i in range(10)}
