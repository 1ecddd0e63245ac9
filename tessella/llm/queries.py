"""One query per operator over its whole table, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm import ann, byte_bpe, lexical, near_dup, packing, phrases, piece_bpe, quality, secret_scan, suffix_dedup, token_counts, topk, toxicity, vectors
from tessella.llm.oracles import ORACLES  # noqa: F401

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@_query
def op1_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf, "documents"), 200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, held = _table(spark, sf, "documents"), toxicity.held_out("doc_id", 3, 1)
    model = toxicity.train(docs, _table(spark, sf, "labels").where(~held))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("sentences").alias("n_offending"), "sentences")


@_query
def op3_adaptive_ann(spark: SparkSession, sf: str) -> DataFrame:
    rows = vectors.usable(_table(spark, sf, "embeddings"), "vec_id", "embedding")
    return ann.search(rows, rows.where("id % 20 = 0"), 20)


@_query
def op4_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Base findings of every document over a ledger of its own; the ledger changes which blobs are scanned, not what is found."""
    return secret_scan.digest(secret_scan.scan(_table(spark, sf, "documents")))


@_query
def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf, "documents"), WORDS, limit=2048)


@_query
def op6_minhash_bottom_k(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf, "documents"), shingle=3, percent=85)


@_query
def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf, "documents"), WORDS, capacity=4096, end_id=1)


@_query
def op8_kd_tree_top_k(spark: SparkSession, sf: str) -> DataFrame:
    rows = topk.quantised(_table(spark, sf, "embeddings"))
    return topk.top_k(rows, rows.where("id % 20 = 0"), 20)


@_query
def op9_quality_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    docs, held = _table(spark, sf, "documents"), toxicity.held_out("doc_id", 5, 0)
    model = quality.train(docs, _table(spark, sf, "labels").where(~held))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op10_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return byte_bpe.digests(_table(spark, sf, "documents"), BYTES, public_tokenizers.PATTERN)


@_query
def op11_piece_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return piece_bpe.digests(_table(spark, sf, "documents"), PIECES)


@_query
def op12_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf, "documents"), least=100, keep=2000, percent=100)


@_query
def op13_block_max_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"), k=10)
