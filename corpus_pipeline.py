"""A corpus pipeline of five stages, each written as Parquet and read again.

Toxic documents go, one document of each group of near-copies stays, repeated 100-byte strings are cut out, sources are
mixed to target weights by copying documents, and what is left is encoded and decoded.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomill.llm import bpe, minhash_dedup, mixing, prefix_free, toxicity
from geomill.llm.common import small_or_not, written

VOCABULARY = "byte_bpe_50k.tiktoken"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model does not reject. Rows without id or text are not toxic and stay."""
    model = toxicity.fit(docs, _labels(spark, sf_dir))
    scored = toxicity.score_documents(docs.select(F.struct("*").alias("row"), "text"), model, key="row")
    return scored.where("not toxic").select("doc_id.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of near-copies."""
    return minhash_dedup.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated 100-byte strings. Parts of a character that a cut leaves behind are dropped.

    Every document stays, if only with an empty text, and n_chars follows the text.
    """
    other = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = prefix_free.remove_repeats(docs, carry=other)
    text = F.expr("try_validate_utf8(cast(kept as string))")
    whole = F.coalesce(text, F.expr("translate(make_valid_utf8(cast(kept as string)), '\\uFFFD', '')"))
    out = out.select("doc_id", whole.alias("text"), *(F.col(f"carried.{c}").alias(c) for c in other))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its mixing rate says, at least once: mixing only adds."""
    rates = mixing.mixing_rates(docs, _labels(spark, sf_dir)).where("doc_id is not null").dropDuplicates(["doc_id"])
    rates = rates.select("doc_id", mixing.copies(F.col("rate"), F.col("doc_id"), at_least=1).alias("__copies"))
    rates = written(rates.where("__copies > 1"), "copies")
    out = docs.join(small_or_not(rates), "doc_id", "left")
    times = F.sequence(F.lit(1), F.coalesce("__copies", F.lit(1)))
    return out.withColumn("__copy", F.explode(times)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text with the digests of the ids and of what they decode to."""
    path = public_tokenizers.path(VOCABULARY)
    return bpe.digests(bpe.encode_documents(docs, path, public_tokenizers.PATTERN, decoded=True), ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing to target weights", mix_sources),
    ("byte-level BPE", encode),
]

#: The model, the components and the projected gradient have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written as Parquet and reread as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
