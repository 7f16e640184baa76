"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of
documents; the last returns the pieces of packed sequences. Between stages the rows are written as Parquet.

Edge cases: every stage takes null, empty and very long texts, repeated rows and empty tables, as its operator says.
SQL can't express the trained stages, so ORACLE_SQL is None and the tests hold the stages against plain versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import langid, near_copies, packing, quality, suffix_dedup
from quadrille.llm.common import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay; those without letters, or of no clear language, go."""
    return langid.recognised(docs, langid.train(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good text stay."""
    return quality.good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles alike by 0.8) the document with the smallest id stays."""
    return near_copies.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes and more that a document with a smaller id has are cut out."""
    return suffix_dedup.deduplicated(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of all documents in sequences of at most 2048."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality", good_quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packed_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
