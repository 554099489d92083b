"""A training corpus from documents: quality rules, near-dedup, substring dedup, mixing, encoding.

STAGES are (name, function); each function takes (spark, docs, sf_dir), works on all rows that the one
before kept, and is written and read again. All but the last return the columns of documents.

Null texts count as empty ones and fall to the quality rules, like all texts of under 50 words. Rows without a
doc_id are no copies of anything; repeated rows count as one document in near-dedup. Texts of any length are
worked on whole, and an empty table stays empty through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relspark.llm import bpe, mixing, neardup, quality, substring
from relspark.llm.common import shared_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text passes the base rules and whose content lines hold most of it; the field is fitted on labelled ones."""
    weights = quality.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality_rules(docs, weights).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return neardup.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that start earlier elsewhere; n_chars follows the text."""
    cut = substring.substring_dedup(docs)
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, from file to file: part by part, and row by row in each."""
    return mixing.in_order(mixing.mix(docs, mixing.WEIGHTS, mixing.DEFAULT_OTHERS)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with mix_position (from 0), n_tokens and ids, in the order of the mix like the files that are read."""
    docs = mixing.in_order(mixing.places(docs))
    return bpe.bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix_sources", mix_sources), ("encode", encode)]

#: Line labels, verified shingle sets and merges are not expressible in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
