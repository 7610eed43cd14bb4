"""From raw documents to encoded ones, in stages that each stand on the one before.

A stage takes (spark, docs, sf_dir), where ``docs`` has the columns of
``documents``, and returns the documents that go on; the last returns their ids
of pieces and whether these decode to the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayscope.llm import decontamination, langid, linededup, pieces, widesimhash
from stayscope.llm.queries import tokenizer_file
from stayscope.session import written_table

#: No SQL does language identification or pieces; tests/llm compares with a brute-force version
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter or without a language that prevails."""
    return langid.known_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that ten documents or more have."""
    return linededup.drop_common_lines(docs, min_docs=10)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: SimHash of five-word shingles, wide enough for a similarity of 0.8."""
    return widesimhash.keep_one(docs, shingle=5, similarity=0.8)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more are words of benchmark windows."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=13)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of pieces of every document that is left, decoded again: the hash of that text and whether it is the document's."""
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text")
    return pieces.encode_texts(chosen, tokenizer_file("piece_bpe_32k.model")).withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmarks", benchmarks), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
