"""A training corpus from the documents table, in stages that each read what the one before wrote.

Every stage but the last returns the columns of ``documents``. Rows with null ids pass all stages; null texts are empty
and pass, as they are neither toxic, nor copies, nor contaminated. An empty table stays empty. Columns beyond those of
``documents`` are dropped by the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineforge.llm import bpe, decontam, minhash, pii
from lineforge.llm import toxicity as toxic
from lineforge.llm.tables import DOCUMENT_COLUMNS, table
from lineforge.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the network, trained on the labelled ones, predicts to be toxic.

    The text travels through the scoring with its row, so nothing is joined. Null texts count as empty, repeated rows
    stay or go together; without labels of both values every row stays unless the share of toxic ones is the threshold.
    """
    labels = table(spark, sf_dir, "labels")
    return toxic.without_toxic(docs.select(*DOCUMENT_COLUMNS), toxic.fit(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; of repeated rows one.

    Rows that share an id but not the text are one document and stay or go together; null ids and texts without words
    are no copies.
    """
    found = minhash.near_duplicates(docs, minhash.Settings(shingle=5))
    copies = found.where("not kept").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(copies, "doc_id", "left_anti").withColumn(
        "__hash", F.xxhash64("text")).dropDuplicates(["doc_id", "__hash"]).drop("__hash")
    return named.unionByName(docs.where("doc_id is null").select(*named.columns)).select(*DOCUMENT_COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents of which a twentieth or more of the words are in windows of the benchmark."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    dirty = found.where("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    same = docs["doc_id"].eqNullSafe(dirty["__id"]) & (F.xxhash64(docs["text"]) == dirty["__hash"])
    return docs.join(dirty, same, "left_anti").select(*DOCUMENT_COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With every span of personal data replaced by its kind; ``n_chars`` counts the new text.

    Null and empty texts and null ids pass as they are, repeated rows alike.
    """
    clean = pii.redacted(F.col("text"), F.col("pii"))
    kept = F.when(F.size("pii") > 0, F.length("clean").cast("long")).otherwise(F.col("n_chars"))
    found = pii.find_pii(docs).withColumn("clean", F.when(F.col("text").isNotNull(), clean))
    return found.withColumn("n_chars", kept).withColumn("text", F.col("clean")).select(*DOCUMENT_COLUMNS)


def byte_pairs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many token ids every text has, with digests of the ids and of the bytes that they decode to.

    A null text is empty. Repeated rows give the same each.
    """
    found = bpe.encode_documents(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN, digests=True)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_pairs", byte_pairs),
]

# Training a classifier and merging byte pairs are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
