"""The registered queries of this subpackage, each an operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.llm import alignment, bpe, cap_filters, fingerprints, license_scan, merkle, minhash_dedup, mixing, paragraph_dedup, prefix_free, sharding, token_counts, toxicity

VOCABULARY, WORDS = "byte_bpe_50k.tiktoken", "word_bpe_49k.json"
#: The two tokenizers that are aligned.
BYTES, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A text of more tokens is over the limit of a model's context.
LIMIT = 2048


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_read(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_paragraphs(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(_read(spark, sf_dir, "embeddings"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_free.remove_repeats(_read(spark, sf_dir, "documents"))
    return out.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    return bpe.digests(bpe.encode_documents(_read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = merkle.document_manifest(docs, tampered=merkle.third(F.col("doc_id")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root", "verified")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))
    return out.withColumn("over_limit", F.col("n_tokens") > LIMIT)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path(BYTES), public_tokenizers.path(PIECES)
    out = alignment.align_documents(_read(spark, sf_dir, "documents"), a, b)
    out = out.withColumn("groups_sha256", F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise(""))
    return alignment.score_links(out, alignment.piece_count(b), ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_sharding": op2_sharding,
    "op3_paragraph_dedup": op3_paragraph_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_mixing": op8_mixing,
    "op9_bpe": op9_bpe,
    "op10_minhash_dedup": op10_minhash_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_counts": op12_token_counts,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": license_scan.ORACLE_SQL,
    "op2_sharding": sharding.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
}
