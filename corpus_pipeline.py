"""Corpus preparation: score quality, drop toxic documents, keep one of each group of near copies, pack for training."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leadfit.llm.common import table, with_package, written
from leadfit.llm.neardup import keep_one_of_each
from leadfit.llm.packing import pack_documents
from leadfit.llm.quality import fit_quality, keep_quality
from leadfit.llm.toxicity import drop_toxic, fit_toxicity

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores at 0.7 or more; learnt on labels outside fold 2 of 4."""
    return keep_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"), parts=4, held_out=2), 0.7)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counterfactual classifier scores below 0.5; learnt on labels outside fold 0 of 5."""
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels"), parts=5, held_out=0), 0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8."""
    return keep_one_of_each(docs, words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Placement of all pieces of the documents that are left in sequences of 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [(name, with_package(stage)) for name, stage in (
    ("quality_classifier", quality), ("toxicity", toxicity), ("minhash_near_dedup", near_dedup), ("best_fit_packing", pack),
)]

ORACLE_SQL = None  # scores of compressors, sketches and tokenizers have no SQL form; tests/llm checks run() by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
