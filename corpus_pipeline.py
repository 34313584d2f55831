"""A training-corpus pipeline: each stage works on all that the one before it kept.

Toxic documents go, one document of each group of near copies stays, repeated passages are cut out, sources are mixed to
their target weights (documents are repeated and, at a target, cut), and what is left is packed into sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import mixing, near_dup, packing, suffix_dedup, toxicity
from siltstone.llm.registry import quality_weights, table, tokenizer_path, toxicity_model
from siltstone.llm.shared import written


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.without_near_duplicates(docs, 80)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, quality=quality_weights(table(spark, sf_dir, "labels")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", remove_toxic),
    ("near_dedup", remove_near_duplicates),
    ("suffix_dedup", remove_repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can't express the learnt toxicity filter nor the tokenizer; the stages are held against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
