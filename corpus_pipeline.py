"""A corpus pipeline: language ID, near-duplicates, personal data, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows of ``docs`` and
returns a DataFrame; :func:`run` writes it as Parquet in the shared folder and
hands the reread table to the next stage.  All stages but the last return the
columns of ``documents``.

Edge cases are those of the operators; an empty table passes through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.llm import langid, mixing, pii, queries, simhash
from costlens.llm.common import DOCUMENT_COLUMNS, documents
from costlens.session import ensure_checkpoint_dir


#: Least score of a language (see ``langid``): letters in random order stay below, held-out documents well above.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language; fills in languages that are not given."""
    found = langid.identify(docs, langid.train(docs), DOCUMENT_COLUMNS)
    known = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash.one_of_each(docs).select(*DOCUMENT_COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*DOCUMENT_COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to the target weights of the sources, in random order."""
    return mixing.mix(docs, queries.MIX_TARGETS).select(*DOCUMENT_COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of ids and decoded bytes."""
    return queries.token_digests(docs, "ids")


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE", tokens),
]

#: SQL can express neither the fingerprints nor the models; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4()}"
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
