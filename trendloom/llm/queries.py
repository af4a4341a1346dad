"""The queries of this subpackage, by name: each applies an operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendloom.llm import byte_bpe, language_id, licenses, media, mixing, neighbours, quality, simhash, toxicity, warc
from trendloom.plans.views import spread

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages", "embeddings") else df


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_table(spark, sf_dir, "embeddings"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds images, so each embedding is drawn as a mosaic; near vectors make edited copies."""
    return media.copies(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), "embedding"), media.mosaic_column("embedding"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_table(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_quality": op2_quality,
    "op3_warc": op3_warc,
    "op4_neighbours": op4_neighbours,
    "op5_licenses": op5_licenses,
    "op6_media": op6_media,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_toxicity": op10_toxicity,
}

#: Where SQL can say the same; the rest are tested against brute force.
ORACLES: dict[str, str] = {
    "op3_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html FROM pages
        ), d AS (
            SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS h FROM p
        ), m AS (
            SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM d
        )
        SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
               CASE WHEN n >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND f <> page_id THEN f END AS refers_to
        FROM m
    """,
    "op4_neighbours": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), d AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM d
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
}
