"""The corpus pipeline: quality classifier, near-duplicates, source mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm import common, mixing, packing, quality, simhash


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the others stay unchanged.

    The classifier is fitted to those labelled documents that this stage gets,
    held-out labels excepted."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 or more of their shingles of five words in common) one document stays."""
    return simhash.keep_one(docs, words=5, differing=6, similar=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by chance, so that a source's share follows the square root of its size."""
    return mixing.mix(docs, extra=False)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mixed corpus into sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [("quality_classifier", good_quality), ("simhash_dedup", near_duplicates), ("mix_sources", mix_sources), ("best_fit_packing", best_fit)]

#: SQL can express neither the classifier, the fingerprints nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written as Parquet in the shared folder and read again by the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
