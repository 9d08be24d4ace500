"""A corpus from raw documents to training sequences, in five stages.

Language ID drops text without a sure language, quality rules drop junk, line dedup takes repeated
lines out of the texts, near-dedup leaves one document of each group, and packing turns what is left
into pieces of training sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kindred.llm import crf_langid, host_quality, line_dedup, minhash_paths, vector_packing
from kindred.llm.common import fold
from kindred.session import cut_lineage, ship_package

LEAST_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the field learns from the labelled rows that are not held out."""
    ship_package(spark)
    field = crf_langid.fit_field(docs.where(fold("doc_id", 3) != 1))
    return crf_langid.keep_known(docs, field, LEAST_LANGUAGE_SCORE)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules; the source is the host."""
    ship_package(spark)
    return host_quality.keep(docs, "source")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that come earlier in the corpus; empty ones go."""
    ship_package(spark)
    return line_dedup.keep_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, at a similarity of 0.8 of five-word shingles."""
    ship_package(spark)
    return minhash_paths.keep_one(docs, minhash_paths.Join(percent=80), repeats=False)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in training sequences, with their token ids."""
    ship_package(spark)
    return vector_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("minhash_near_dedup", near_dedup),
    ("packing", packing),
]

# The language model and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
