"""The corpus pipeline: what a training corpus keeps, and how it is packed.

Each stage works on all rows of the one before it, which is written as a table and read again. Language and quality models are
learned from the rows that a stage gets, by the folds that the operators use; every row is judged, none is sampled away.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipsift.llm import langid, packing, quality, simhash
from clipsift.llm._common import cut, drop_cut, fold_of

#: A language prediction below this share is a rejection; with four languages an even one is 0.25.
LANGUAGE_SHARE = 0.4
#: A quality score below this is a rejection.
QUALITY_SCORE = 0.5
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a learned language; no letters, no text or too even a prediction is a rejection."""
    model = langid.learn(docs, fold_of(F.col("doc_id"), 4) != 2)
    return langid.keep(docs, model, LANGUAGE_SHARE)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the most similar labelled texts don't vote down."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(docs, quality.learn(docs, labels, fold_of(F.col("doc_id"), 4) != 2), QUALITY_SCORE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike in 0.8 or more of their five-word shingles, as SimHash proposes them, the row with the smallest id."""
    return simhash.representatives(docs, shingle=5, similarity=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("packing", packed),
]

#: Neither models nor tokenizers can be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_cut(*held)
        held = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
