"""Corpus pipeline: STAGES over ``documents``; each stage's result is written and read again.

Toxic documents go; of each group of near copies one stays; documents that hold a benchmark item
go; secrets are cut out of the texts; what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causelake.llm.bpe import encode_documents, public_spec
from causelake.llm.common import materialise, table
from causelake.llm.decontaminate import without_contaminated
from causelake.llm.near_dup import representatives
from causelake.llm.secrets import redacted
from causelake.llm.toxicity import toxicity_model, without_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-or model (fitted to this stage's documents) scores below 0.5."""
    return without_toxic(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the parity-sketch join links."""
    return representatives(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with ``[SECRET]`` for each secret; a clean text stays as it is."""
    return redacted(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and their digests."""
    return encode_documents(docs, public_spec("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("tokens", token_stage),
]

#: SQL cannot fit the toxicity model or merge byte pairs; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
