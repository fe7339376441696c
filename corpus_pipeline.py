"""A training corpus from documents: filter, exact and near deduplication, mixing, packing.

Each stage is written as Parquet in the shared folder and read back as the next one's documents. A stage deletes nothing that
its result reads; ``run``, which writes that result, deletes the stage's own tables and the stage before's once it is written.

Defined cases, in all stages: a null text counts as empty; a null source or lang is a value of its own; repeated rows are rows of
their own until a stage drops copies, which leaves one of equal texts whatever their ids; columns that a stage doesn't know
are kept up to packing; no documents give none. Without labels the quality stage keeps all.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphjobs.llm import common, exact, mixing, packing, quality, shingles


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model samples; the others go."""
    return quality.sampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles, alike to 0.8, link: the one with the smallest id."""
    return shingles.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights ask for."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, XXH64 and the tokenizer are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES:
        with common.recorded() as made:
            out = common.stage(step(spark, docs, sf_dir), name)
        for own in [t for t in made.values() if t is not out]:
            common.unstage(own)
        if before is not None:
            common.unstage(before)
        docs = before = out
    return docs
