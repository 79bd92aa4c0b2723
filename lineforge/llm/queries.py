"""The registered queries of the text operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineforge.llm import (
    bpe, collocations, decontam, hilbert, importance, langid, minhash, passages, pii, pitman_yor, spotsigs, url_rules,
)
from lineforge.llm import toxicity as toxic
from lineforge.llm.tables import table

Query = Callable[[SparkSession, str], DataFrame]


RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def op1_language_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spotsigs.edited_fingerprints(table(spark, sf_dir, "documents"))
    sigs, edited = F.col("sigs"), F.col("edited_sigs")
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spotsigs.as_text(sigs).alias("fingerprint"), spotsigs.as_text(edited).alias("edited_fingerprint"),
        spotsigs.likeness(sigs, edited).alias("near_edited"),
        spotsigs.likeness(sigs, F.col("next_sigs")).alias("near_next"))


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert.shards(table(spark, sf_dir, "documents"), count=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(table(spark, sf_dir, "documents"))


def op5_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE),
                                public_tokenizers.PATTERN, digests=True)


def op6_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_benchmark_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op8_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Settings(shingle=4))


def op9_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op10_pii_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    counts = [pii.count_kind(F.col("pii"), kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.as_text(base), 256).alias("base_sha256"),
                        pii.as_text(F.col("pii")).alias("spans"), F.size("pii").cast("long").alias("n_spans"),
                        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"))


def op11_crc_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op13_setm_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_language_softmax, op2_spotsigs, op3_hilbert_shards, op4_pitman_yor, op5_segment_tree_bpe, op6_toxicity_bigru,
    op7_benchmark_ngrams, op8_minhash_odd_sketch, op9_compact_windows, op10_pii_checksums,
    op11_crc_importance, op12_url_rules, op13_setm_phrases,
)}
