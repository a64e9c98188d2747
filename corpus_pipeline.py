"""A corpus pipeline of the operators in ``loomgraph.llm``; each stage's result is the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontam, minimax, mixing, oddsketch, toxicity
from loomgraph.plans.shared import staged, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return oddsketch.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minimax.minimax_shards(docs)


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix_sources), ("sharding", shard)]

#: The stages learn, sketch and draw; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage but the last is written and read again, so none is computed twice."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
