"""Pages of an ordered listing by key: sorted once into folders of pages, so that any page is read from one folder."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.plans.shared import shared_folder, stage

#: Pages of a folder.
PAGES = 64


@dataclass(frozen=True)
class Pages:
    """A listing of ``rows`` rows in pages of ``size``; ``path`` has a folder for each PAGES pages."""

    spark: SparkSession
    path: str
    order: list[str]
    size: int
    rows: int
    schema: str

    @property
    def pages(self) -> int:
        return -(-self.rows // self.size)

    def page(self, number: int) -> DataFrame:
        """The rows of a page from 0, in order; none beyond the last one."""
        rows = self.spark.read.schema(f"{self.schema}, page long, chunk long").parquet(self.path)
        return rows.filter((F.col("chunk") == number // PAGES) & (F.col("page") == number)).drop("page", "chunk").orderBy(*self.order)


def pages(df: DataFrame, order: list[str], size: int = 200) -> Pages:
    """Sorts ``df`` once. Rows that tie are ordered by their other columns, so every row is on one page; equal rows may swap among themselves."""
    spark = df.sparkSession
    every = [*order, *[c for c in df.columns if c not in order]]
    ranges = stage(df.repartitionByRange(*every).withColumn("_range", F.spark_partition_id()))
    read = spark.read.parquet(ranges)
    counts = {r["_range"]: r["n"] for r in read.groupBy("_range").agg(F.count("*").alias("n")).collect()}  # a row for each task
    before, total = {}, 0
    for k in sorted(counts):
        before[k], total = total, total + counts[k]
    offsets = spark.createDataFrame([(int(k), int(v)) for k, v in before.items()], "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*every)) - 1 + F.col("_before")
    numbered = read.join(F.broadcast(offsets), "_range").withColumn("page", F.floor(place / size)).withColumn("chunk", F.floor(F.col("page") / PAGES)).drop("_range", "_before")
    path = f"{shared_folder(spark)}/loomgraph-{uuid.uuid4().hex}"
    numbered.write.option("compression", "zstd").partitionBy("chunk").parquet(path)
    return Pages(spark, path, every, size, total, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields))
