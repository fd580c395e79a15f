"""The corpus pipeline: documents through language ID, exact and near deduplication, and packing.

A null or empty text goes in the first stage, since it is in no language. A null id travels along:
of equal texts it yields to any id, and near deduplication never drops it. Repeated rows become one
in exact deduplication. Texts of any length go whole, and an empty table gives no pieces.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from lumigrid.llm import exact, langid, near, packing
from lumigrid.llm.common import materialize
from lumigrid.llm.queries import WORD_BPE


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, or far from every learned language, go."""
    return langid.drop_unidentified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest id stays."""
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles the smallest id stays."""
    return near.drop_near_copies(docs, words=5, at_least=Fraction(4, 5))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, a row per piece."""
    return packing.pack_documents(docs, WORD_BPE, end_id=1)


STAGES = [("language ID", identify_language), ("exact dedup", drop_exact_copies), ("near dedup", drop_near_copies), ("packing", pack)]

#: Neither the language model nor the near-duplicate graph nor packing has a SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each reading its predecessor's rows back from a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
