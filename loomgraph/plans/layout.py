"""Triples on disk by groups of predicates, so that a pattern reads the folders of its predicate only."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.shared import shared_folder

#: Folders that a table of triples has at most; a predicate lies in one.
GROUPS = 32
#: The partition column, an int.
GROUP = "predicate_group"


#: Bytes of files, and of shuffled triples, that a task takes: they are compressed, and take up to fifty times as much memory.
TASK_BYTES = {"spark.sql.files.maxPartitionBytes": "8m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m"}

#: Partitions that a shuffle is dealt to before Spark merges the small ones, unless the session has more: a group or a join never takes a larger share of the rows than
#: one of them. Up to 200, a task that deals rows holds none of them.
PARTITIONS = 200
_DEALT = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


@contextmanager
def small_tasks(spark: SparkSession, many: bool = True) -> Iterator[None]:
    """Jobs that run meanwhile have tasks of TASK_BYTES, however large the tables. ``many``: shuffles are dealt to PARTITIONS or more."""
    wanted = TASK_BYTES | ({_DEALT: str(max(PARTITIONS, int(spark.conf.get("spark.sql.shuffle.partitions"))))} if many else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def group_of(predicate: Column) -> Column:
    return F.pmod(F.xxhash64(predicate), F.lit(GROUPS)).cast("int")


def with_predicates(triples: DataFrame, predicates: list[str]) -> DataFrame:
    """``triples`` narrowed to the folders that can have these predicates, where they lie by predicate; the rows still need the filter by predicate."""
    if GROUP not in triples.columns:
        return triples
    return triples.filter(F.col(GROUP).isin([group_of(F.lit(p)) for p in predicates])) if predicates else triples.limit(0)


@dataclass
class Layout:
    """A folder in the shared one whose parts, one for each call of ``add``, are read together or by themselves."""

    spark: SparkSession
    root: str
    parts: int = 0

    @classmethod
    def new(cls, spark: SparkSession) -> Layout:
        return cls(spark, f"{shared_folder(spark)}/loomgraph-{uuid.uuid4().hex}")

    def add(self, triples: DataFrame, many: bool = True) -> int:
        """Writes (s, p, o, ...) by groups of predicates, with equal predicates, and their objects, side by side; returns the part's number. ``many``: rows of
        a group are dealt to one task or, where they are many, to several of about equal size; else each task writes a file for each of its groups."""
        part, self.parts = self.parts, self.parts + 1
        grouped = triples.withColumn(GROUP, group_of(F.col("p")))
        grouped = (grouped.hint("rebalance", F.col(GROUP)) if many else grouped).sortWithinPartitions(GROUP, "p", "o")
        with small_tasks(self.spark, many):
            grouped.write.option("compression", "zstd").partitionBy(GROUP).parquet(f"{self.root}/part={part}")
        return part

    def read(self, parts: list[int], schema: str = "s string, p string, o string") -> DataFrame:
        """One scan of some parts, with the group's column."""
        rows = self.spark.read.schema(f"{schema}, part int, {GROUP} int").option("basePath", self.root)
        return rows.parquet(*[f"{self.root}/part={k}" for k in parts]).drop("part")


def laid_out(triples: DataFrame) -> DataFrame:
    """``triples`` (s, p, o) written once by predicate; the rows of a task go to a file for each of its groups."""
    files = Layout.new(triples.sparkSession)
    return files.read([files.add(triples.select("s", "p", "o"), many=False)])
