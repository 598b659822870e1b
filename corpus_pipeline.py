"""The corpus pipeline: five operators over ``documents``, each on all that the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a frame; ``run`` writes
each result as Parquet in the shared folder that the cluster names and reads it
again for the next stage, so a lost executor costs tasks of one stage only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliograph.llm import contamination, langid, mixing, sharding, simhash
from foliograph.llm.common import scratch_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; those without a letter go."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that shares 0.8 of its five-word shingles."""
    return simhash.keep_one(docs, similarity=0.8, width=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return contamination.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers that bring the domains to their target weights."""
    return mixing.resample(docs, mixing.label_domains(table(spark, sf_dir, "labels")), mixing.TARGETS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.digest(sharding.assign(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontaminate", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: The stages learn models and walk graphs; SQL cannot express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents of ``sf_dir``."""
    place = scratch_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return docs
