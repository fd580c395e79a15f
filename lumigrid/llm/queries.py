"""One query per corpus operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, counts, exact, html, langid, lm, media, near, packing, sharding

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_exact_dedup(spark, folder):
    return exact.exact_dedup(_table(spark, folder, "documents"))


def op2_media_columns(spark, folder):
    return media.media_features(media.store_media(_table(spark, folder, "documents")))


def op3_html_extraction(spark, folder):
    return html.extract_pages(_table(spark, folder, "pages"))


def op4_bpe(spark, folder):
    return bpe.bpe_digests(_table(spark, folder, "documents"), WORD_BPE)


def op5_packing(spark, folder):
    return packing.pack_documents(_table(spark, folder, "documents"), WORD_BPE, end_id=1)


def op6_token_counts(spark, folder):
    return counts.token_counts(_table(spark, folder, "documents"), PIECES)


def op7_sharding(spark, folder):
    return sharding.shard_documents(_table(spark, folder, "documents"), 16)


def op8_near_dedup(spark, folder):
    return near.near_groups(_table(spark, folder, "documents"), words=3, at_least=Fraction(85, 100))


def op9_language_id(spark, folder):
    return langid.identify(_table(spark, folder, "documents"))


def op10_lm_scores(spark, folder):
    return lm.score_documents(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_dedup, op2_media_columns, op3_html_extraction, op4_bpe, op5_packing, op6_token_counts, op7_sharding, op8_near_dedup, op9_language_id, op10_lm_scores)}

ORACLE_SQL = {
    "op1_exact_dedup": """
        WITH normal AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS plain FROM documents
        ), numbered AS (
            SELECT doc_id, plain, row_number() OVER (PARTITION BY plain ORDER BY doc_id DESC NULLS LAST) AS place FROM normal
        )
        SELECT doc_id, max(doc_id) OVER (PARTITION BY plain) AS keep_id, count(*) OVER (PARTITION BY plain) AS group_size,
               place = 1 AS kept, sha256(plain) AS text_sha256
        FROM numbered
    """,
}
