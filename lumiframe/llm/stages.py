"""Stages of the training-data pipeline and their run over ``documents``.

All stages take null and empty texts as texts without words, read very long texts
whole, keep further columns whatever their names, and give an empty table for an
empty one. Repeated rows and null keys are treated as the docstring of the stage
or of its operator says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .decontaminate import is_leaked
from .mixing import mixed_rows
from .scratch import Scratch
from .simhash import one_of_each
from .token_files import tokenize_to_files
from .toxicity import keep_clean


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; equal texts go or stay together, null keys are scored too."""
    return keep_clean(docs, _table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: three-word shingles, three bits.

    All texts without words are one group. Of repeated rows one stays; a null key
    stays only where its group has no other.
    """
    return one_of_each(docs, shingle=3, max_bits=3)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark item; repeated rows go or stay together, texts without words stay."""
    return docs.where(~is_leaked(_table(spark, sf_dir, "benchmark"), docs["text"]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixed_rows(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, one result row each."""
    return tokenize_to_files(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("source_mixing", mix_sources),
    ("token_files", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
