"""A training-data pipeline: language ID, toxicity, SimHash near-dedup, mixing, byte-level BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trendloom.llm.byte_bpe import encode_table
from trendloom.llm.language_id import keep_identified
from trendloom.llm.mixing import mixed
from trendloom.llm.shingles import similar_components
from trendloom.llm.simhash import keep_one
from trendloom.llm.toxicity import keep_clean
from trendloom.plans.scratch import Scratch

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told.

    Null and empty texts and those without a letter go; long texts are judged whole; a
    posterior of just one half stays; repeated rows stay or go together. Rows with a null id or
    source are judged like others; columns of any name pass through; no documents give none.
    """
    return keep_identified(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic.

    Null texts and those without a word stay, as do all documents if labels teach nothing;
    a score of just the threshold goes; long texts are judged whole; repeated rows stay or go
    together; null labels and ids teach nothing; columns of any name pass through; no
    documents give none.
    """
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by SimHash or by five-word shingles with similarity 0.8 or more.

    The smallest id of a group stays. Null and empty texts are one group; long texts count
    whole; of rows that repeat an id each different text stays once; rows without an id stay;
    columns of any name pass through; no documents give none.
    """
    return keep_one(docs, similar_components)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Null and empty texts are never taken; a null source is a source, the last in order; ties go
    by a hash of id and text, so reruns agree; repeated rows count each; long texts count whole;
    columns of any name pass through; no documents give none.
    """
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row of the mix.

    Null and empty texts have no tokens; long texts are encoded whole; repeated rows, null ids
    included, give a row each; other columns are let go; no rows give none.
    """
    return encode_table(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [
    ("language ID", language),
    ("toxicity", toxic),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

#: The stages' models and budgets can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each one's result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage{k}")
    return docs
