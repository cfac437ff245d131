"""Registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, langid, licences, mixing, packing, periodic, pii, quality, secrets, sharding, simhash, weighted
from .common import documents

#: Shares of the mix; the other sources share the rest.
MIX_TARGETS = {"src0": 0.15, "src1": 0.10, "src2": 0.08, "src3": 0.02, "src4": 0.01}

BPE_RANKS = "byte_bpe_50k.tiktoken"

#: Special tokens of the same vocabulary.
BPE_SPECIAL = {"<|endoftext|>": 50256}


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents repeated to the target weights, in random order."""
    return mixing.mix(documents(spark, sf_dir), MIX_TARGETS)


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of every document."""
    return licences.scan(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, tokens and rows."""
    return sharding.shard(documents(spark, sf_dir), shards=16)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: fixed patterns and what the conditional random field adds."""
    return pii.digest(documents(spark, sf_dir))


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those that are not held out."""
    docs = documents(spark, sf_dir)
    model = langid.train(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for secrets in every document, each with the forest's verdict."""
    model = secrets.train(secrets.labelled_findings(spark))
    return secrets.scan(documents(spark, sf_dir), model)


def token_digests(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, number of tokens, digests of ids and decoded bytes, and ``more`` outputs of the tokenizer."""
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256", *more)
    return bpe.tokenize(docs, public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, outputs)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document and its round trip."""
    return token_digests(documents(spark, sf_dir))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted fingerprints of every document and its edited text."""
    return weighted.neighbours(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict of every document."""
    return quality.judge(documents(spark, sf_dir))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, packed into sequences of at most 1024 tokens."""
    return packing.pack_documents(documents(spark, sf_dir), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN,
                                  BPE_SPECIAL, capacity=1024, end_id=2)


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document, of which every tenth gets a periodic tail first."""
    return periodic.periodic_runs(documents(spark, sf_dir), periodic.DIGESTS, periodic.repeat_tail)


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove per source in all their orders."""
    return audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_licences": op2_licences,
    "op3_sharding": op3_sharding,
    "op4_pii": op4_pii,
    "op5_language_id": op5_language_id,
    "op6_simhash": op6_simhash,
    "op7_secrets": op7_secrets,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_fingerprints": op9_fingerprints,
    "op10_quality": op10_quality,
    "op11_packing": op11_packing,
    "op12_periodic": op12_periodic,
    "op13_audit": op13_audit,
}
