"""The corpus pipeline: language identification, near-dedup, decontamination, mixing, sharding.

Every stage takes all documents that its predecessor kept, as they were written, and all but the last return the
columns of documents; the last adds the shard, and slot and place: within each shard the sources are interleaved by
the schedule of the mixing stage, and a shard is read in order of place. Null, empty and repeated rows are treated as the
operators say: texts without letters are rejected by the first stage, of repeated rows one stays after the second. An
empty table gives no rows; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from snapdelta.llm import common
from snapdelta.llm.decontamination import decontaminate
from snapdelta.llm.language_id import language_id
from snapdelta.llm.minhash import remove_near_duplicates
from snapdelta.llm.mixing import mixed_documents
from snapdelta.llm.sharding import sharded_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that no language accounts for."""
    return language_id(docs, passing=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group of near-duplicates."""
    return remove_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out of the texts."""
    return decontaminate(docs, common.read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Interleaves the sources by their target weights; small sources repeat."""
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard of each document, and its place in the shard's mix of sources."""
    return sharded_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", near_dedup),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Mixture inference by expectation-maximisation and shard assignment by iteration have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
