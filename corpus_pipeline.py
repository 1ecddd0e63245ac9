"""A corpus pipeline: each stage works on the whole of what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm import near_dup, packing, secret_scan, suffix_dedup, toxicity
from tessella.llm.queries import WORDS
from tessella.llm.units import unused
from tessella.session import scratch, small_batches


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of score 0.7 or more go; the model learns from the labels of two thirds of the ids, as in the query.

    Null and empty texts are clean. Rows without an id and repeated rows are scored like others; columns stay as they are.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out("doc_id", 3, 1))
    return toxicity.keep_clean(docs, toxicity.train(docs, labels), 0.7)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (shingles of five words, similarity 0.8) the smallest id stays.

    Rows that repeat both id and text are one row; an id with several texts keeps each. Rows without an id are
    compared by their whole text only: one of each text stays, and none where the text also stands under an id.
    Rows with neither id nor text all stay.
    """
    small_batches(spark)
    gone = near_dup.near_duplicates(docs, shingle=5, percent=80).where("NOT kept").select("doc_id").distinct()
    digest = unused("digest", docs.columns)
    marked = docs.withColumn(digest, F.sha2("text", 256))
    once = marked.where("doc_id IS NOT NULL OR text IS NOT NULL").dropDuplicates(["doc_id", digest])
    named = once.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti")
    known = marked.where("doc_id IS NOT NULL AND text IS NOT NULL").select(digest).distinct()
    nameless = once.where("doc_id IS NULL").join(known, digest, "left_anti")
    blank = marked.where("doc_id IS NULL AND text IS NULL")
    return named.unionByName(nameless).unionByName(blank).select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that stand more than once are cut out of the texts; no document is dropped.

    A null text stays null, repeated rows are each other's repeats, ids are not read.
    """
    small_batches(spark)
    return _counted(suffix_dedup.without_repeats(docs, 200))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document is dropped. A null text stays null, ids are not read."""
    small_batches(spark)
    return _counted(secret_scan.redact(docs, secret_scan.scan(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 4096 tokens; a null text is empty, repeated rows and rows without an id are packed each."""
    small_batches(spark)
    return packing.pack_documents(docs, WORDS, capacity=4096, end_id=1)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES = [("toxicity", toxic), ("MinHash near-dedup", near_copies), ("suffix-array dedup", repeats), ("secret scans", secrets), ("best-fit packing", pack)]
#: Learned scores and packings have no SQL; tests/llm/test_pipeline.py holds each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        folder = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
