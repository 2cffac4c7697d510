"""The corpus pipeline: language ID, exact dedup, near dedup, benchmark decontamination, byte-level BPE.

STAGES are applied to `documents` in turn. Each works on all that the one before kept; what it writes is read again as
the next one's input. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from amberline.llm import decontaminate, grace_dedup, language_id, prefix_bpe, simhash
from amberline.llm.common import materialise, table
from amberline.llm.queries import BYTE_BPE
from amberline.packaging import ship


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with enough margin."""
    ship(spark)
    return language_id.accepted(docs, language_id.learned(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts."""
    ship(spark)
    return grace_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    ship(spark)
    return simhash.survivors(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token count and digests of each document that is left."""
    ship(spark)
    return prefix_bpe.digests(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)


STAGES = [("languages", languages), ("exact", exact), ("near", near), ("decontaminated", decontaminated), ("encoded", encoded)]
#: Language identification by compression is not expressible in SQL; tests/llm compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
