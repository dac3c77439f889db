"""Corpus pipeline: STAGES in order, each on all that the one before kept.

Language ID rejects texts that fit no language, near-duplicate removal leaves one document of each group, decontamination
takes out documents that hold a benchmark item, the mix repeats or leaves documents so that each source meets its target,
and the last stage writes token files and returns one row per document from them. All but the last keep the columns of the
documents, whatever further columns these have.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sensorloom.llm import decontam, langid, mixing, neardup, tokens
from sensorloom.llm.common import table
from sensorloom.session import spool_root


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that language ID rejects (operator 10): no letters, or unlike every language learned."""
    return langid.accepted_only(docs, langid.fit(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates (operator 3): five-word shingles, similarity 0.8 or more."""
    return neardup.without_copies(docs, width=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item within an edit similarity of 0.8 (operator 4)."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mix the sources to their target weights (operator 6); a document comes as often as it is taken."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files (operator 2) and return one row per document from them."""
    path = tokens.token_folder(spark)
    tokens.write_tokens(docs, path)
    return tokens.token_digests(spark, path)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("source_mix", mixed),
    ("token_files", token_files),
]

# Language models, sketches and encodings are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{spool_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
