"""Registered queries of the subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayscope.llm import bpecount, decontamination, langid, linededup, merkle, ngram, orderminhash, pieces, sharding, simhash, spelling, substringdedup, suffixindex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_file(name: str) -> str:
    """Vocabulary file of a public tokenizer; installed on driver and workers alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


_SPACE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query
def op7_line_dedup(spark, folder):
    return linededup.line_report(documents(spark, folder), min_docs=10)


ORACLE["op7_line_dedup"] = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place, unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents),
keyed AS (SELECT doc_id, place, line, {_LOWER.format(f'trim(line, {_SPACE})')} AS line_key FROM lines),
often AS (SELECT line_key FROM keyed WHERE line_key <> '' GROUP BY line_key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.*, o.line_key IS NOT NULL AS gone FROM keyed k LEFT JOIN often o ON k.line_key = o.line_key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


@_query
def op4_token_counts(spark, folder):
    return bpecount.token_counts(documents(spark, folder), tokenizer_file("byte_bpe_50k.json"), limit=512)


@_query
def op8_sharding(spark, folder):
    return sharding.shard_table(documents(spark, folder), shards=8)


@_query
def op9_language_id(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    return langid.identify(docs, parts=3, part=1)


@_query
def op2_document_fingerprints(spark, folder):
    return orderminhash.fingerprints(documents(spark, folder), k=2, take=2, tuples=32)


@_query
def op5_sentencepiece(spark, folder):
    return pieces.encoding_report(documents(spark, folder), tokenizer_file("piece_bpe_32k.model"))


@_query
def op6_simhash(spark, folder):
    return simhash.near_duplicates(documents(spark, folder), shingle=3, distance=3)


@_query
def op10_substring_dedup(spark, folder):
    return substringdedup.repeat_report(documents(spark, folder), substringdedup.Repeats(window=50))


ORACLE["op10_substring_dedup"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS at_word FROM d WHERE len(w) >= 50),
windows AS (SELECT doc_id, at_word, md5(array_to_string(w[at_word:at_word + 49], ' ')) AS h FROM starts),
least AS (SELECT h, min(doc_id) AS first_doc FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(at_word, at_word + 49)) AS k FROM windows JOIN least USING (h) WHERE first_doc < doc_id),
each_word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM d),
kept AS (
  SELECT e.doc_id, count(*) AS n_words, count(g.k) AS n_removed, string_agg(word, ' ' ORDER BY e.k) FILTER (g.k IS NULL) AS kept
  FROM each_word e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.k = g.k GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""


@_query
def op3_decontamination(spark, folder):
    return decontamination.contamination_report(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"), width=13)


_WORDS = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(_LOWER.format("coalesce(text, '')"))

ORACLE["op3_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
b_starts AS (SELECT item_id, w, least(13, len(w)) AS size, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS k FROM b WHERE len(w) > 0),
b_windows AS (SELECT DISTINCT item_id, size, array_to_string(w[k:k + size - 1], ' ') AS phrase FROM b_starts),
sizes AS (SELECT DISTINCT size FROM b_windows),
d_starts AS (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS k FROM d, sizes WHERE len(w) >= size),
d_windows AS (SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS phrase FROM d_starts),
met AS (SELECT doc_id, d_windows.size, k, item_id FROM d_windows JOIN b_windows USING (size, phrase)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + size - 1)) AS p FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""


@_query
def op1_lm_scoring(spark, folder):
    return ngram.score_held_out(documents(spark, folder), parts=7, part=2)


@_query
def op11_spelling_variants(spark, folder):
    return spelling.spelling_variants(documents(spark, folder), least_length=5, least_count=3, slip=97)


@_query
def op12_merkle_manifest(spark, folder):
    return merkle.manifest_report(spark.read.parquet(f"{folder}/documents.parquet"), arity=3)


def _framed(text: str) -> str:
    names = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')" for c in names) + ")"


# the checksum bit by bit, one character of the id after another
_CHECK = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""

ORACLE["op12_merkle_manifest"] = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, source, {_framed("text")} AS leaf,
    CASE WHEN {_CHECK} % 2 = 0 THEN {_framed("replace(text, chr(10), '')")} ELSE {_framed("text")} END AS seen
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS id, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
    count(*) OVER (PARTITION BY tree) AS total FROM hashed),
nodes AS (
  SELECT tree, 0 AS level, place, total, leaf AS hash FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 3, (total + 2) // 3, sha256(string_agg(hash, '' ORDER BY place)) FROM nodes WHERE total > 1 GROUP BY tree, level, place // 3, total),
subroots AS (SELECT tree, hash FROM nodes WHERE total = 1),
upper AS (
  SELECT 0 AS level, tree AS place, count(*) OVER () AS total, hash FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, (total + 2) // 3, sha256(string_agg(hash, '' ORDER BY place)) FROM upper WHERE total > 1 GROUP BY level, place // 3, total),
folded AS (
  SELECT id, tree, 0 AS level, place, total, seen AS node, '' AS proof FROM leaves
  UNION ALL
  SELECT f.id, f.tree, f.level + 1, f.place // 3, (f.total + 2) // 3, sha256(string_agg(CASE WHEN n.place = f.place THEN f.node ELSE n.hash END, '' ORDER BY n.place)),
    f.proof || coalesce(string_agg(n.hash, '' ORDER BY n.place) FILTER (n.place <> f.place), '')
  FROM folded f JOIN nodes n ON n.tree = f.tree AND n.level = f.level AND n.place // 3 = f.place // 3
  WHERE f.total > 1 GROUP BY f.id, f.tree, f.level, f.place, f.total, f.node, f.proof),
lifted AS (
  SELECT id, 0 AS level, tree AS place, (SELECT count(*) FROM subroots) AS total, node, proof FROM folded WHERE total = 1
  UNION ALL
  SELECT f.id, f.level + 1, f.place // 3, (f.total + 2) // 3, sha256(string_agg(CASE WHEN n.place = f.place THEN f.node ELSE n.hash END, '' ORDER BY n.place)),
    f.proof || coalesce(string_agg(n.hash, '' ORDER BY n.place) FILTER (n.place <> f.place), '')
  FROM lifted f JOIN upper n ON n.level = f.level AND n.place // 3 = f.place // 3
  WHERE f.total > 1 GROUP BY f.id, f.level, f.place, f.total, f.node, f.proof)
SELECT l.doc_id, l.leaf, s.hash AS subroot, r.hash AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = r.hash AS verified
FROM leaves l JOIN lifted f ON f.id = l.id AND f.total = 1 JOIN subroots s ON s.tree = l.tree JOIN upper r ON r.total = 1"""


@_query
def op13_suffix_array_dedup(spark, folder):
    return suffixindex.repeat_report(documents(spark, folder), suffixindex.Repeats(length=100))


ORACLE["op13_suffix_array_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(generate_series(0, len(h) // 2 - 100)) AS s FROM d WHERE len(h) >= 200),
windows AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS k FROM starts),
repeats AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM windows) WHERE n > 1),
begun AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM repeats),
numbered AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM begun),
runs AS (SELECT doc_id, run, min(s) AS low, max(s) + 100 AS high FROM numbered GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, low, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS a, low AS b FROM runs
  UNION ALL
  SELECT doc_id, 9223372036854775807, max(high), 9223372036854775807 FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, least(b - a, len(h)) * 2), '' ORDER BY low) AS h FROM pieces JOIN (SELECT doc_id, h FROM d) USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, len(d.h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN sums ON d.doc_id = sums.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id"""
