"""Corpus pipeline: language ID, near-dedup, benchmark decontamination, PII and byte-level BPE over ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from caseflow.llm._common import stage
from caseflow.llm.bpe import with_tokens
from caseflow.llm.decontaminate import remove_contaminated
from caseflow.llm.language import keep_identified
from caseflow.llm.pii import DEMO_KEY, with_pseudonyms
from caseflow.llm.simhash import near_dedup

#: Setting of the session that holds the secret key of the pseudonyms. Unset, the public demonstration key is used, whose
#: pseudonyms anybody can invert.
KEY_SETTING = "spark.caseflow.pseudonym.key"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return keep_identified(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return near_dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by pseudonyms, by the key in the setting KEY_SETTING."""
    return with_pseudonyms(docs, key=spark.conf.get(KEY_SETTING, DEMO_KEY))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and the texts that these decode to."""
    return with_tokens(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express fingerprints, trained profiles and merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
