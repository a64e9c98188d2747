"""An index of names and labels for substring search: lists of the places of every three characters, staged once and read by folder."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import vocab as V
from loomgraph.functions import terms
from loomgraph.plans.shared import shared_folder

#: Characters of a gram, and folders that grams are dealt to.
SIZE, FOLDERS = 3, 64


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def _grams(text: Column) -> Column:
    """(at, gram) of a text's characters: at each the next SIZE, fewer at the end."""
    chars = F.split(text, "")
    gram = chars
    for k in range(2, SIZE + 1):
        gram = F.zip_with(gram, F.slice(chars, k, F.length(text)), lambda g, c: F.concat(g, F.coalesce(c, F.lit(""))))
    return F.transform(gram, lambda g, i: F.struct(i.alias("at"), g.alias("gram")))


@dataclass(frozen=True)
class LabelIndex:
    """``path``: rows (gram, x, number, at): the gram's places in the IRI (number 0) or a label (from 1) of the entity x; a folder for each FOLDERS-th of the
    grams, sorted by gram inside."""

    spark: SparkSession
    path: str

    def search(self, text: str) -> DataFrame:
        """(x): entities whose IRI or any label has the text, whatever the case: those where all of its grams follow each other. Reads the folders of these
        grams; a text shorter than a gram, the grams that begin with it. Every entity has the empty text."""
        wanted = text.lower()
        rows = self.spark.read.parquet(self.path)
        if len(wanted) < SIZE:
            return rows.filter(F.col("gram").startswith(wanted)).select("x").distinct()
        places = {k: wanted[k : k + SIZE] for k in range(len(wanted) - SIZE + 1)}
        grams = sorted(set(places.values()))
        near = rows.filter(F.col("folder").isin([_folder(F.lit(g)) for g in grams]) & F.col("gram").isin(grams))
        if len(grams) == 1 and len(places) == 1:
            return near.select("x").distinct()
        starts = F.explode(F.element_at(F.create_map(*[y for g in grams for y in (F.lit(g), F.array(*[F.lit(k) for k, x in places.items() if x == g]))]), F.col("gram")))
        begun = near.select("x", "number", "at", starts.alias("k")).withColumn("start", F.col("at") - F.col("k"))
        return begun.groupBy("x", "number", "start").agg(F.count("*").alias("n")).filter(F.col("n") == len(places)).select("x").distinct()


def label_index(triples: DataFrame) -> LabelIndex:
    """The index of all IRIs and blank nodes at the ends of triples and of all labels of subjects; literals as subjects aren't named by themselves. An empty label
    is found by the empty text only, through its entity's name."""
    spark = triples.sparkSession
    ends = triples.select(F.explode(F.array("s", "o")).alias("x")).filter(~F.col("x").startswith('"')).distinct()
    names = ends.select("x", F.lit(0).alias("number"), F.lower("x").alias("text"))
    labels = triples.filter(F.col("p") == V.LABEL).select(F.col("s").alias("x"), F.lower(terms.lex(F.col("o"))).alias("text")).distinct()
    numbered = labels.groupBy("x").agg(F.array_sort(F.collect_set("text")).alias("texts")).select("x", F.posexplode("texts").alias("number", "text")).withColumn("number", F.col("number") + 1)
    rows = names.unionByName(numbered).filter("text <> ''").select("x", "number", F.explode(_grams(F.col("text"))).alias("g")).select("g.gram", "x", "number", "g.at")
    path = f"{shared_folder(spark)}/loomgraph-{uuid.uuid4().hex}"
    dealt = rows.withColumn("folder", _folder(F.col("gram"))).hint("rebalance", F.col("folder")).sortWithinPartitions("folder", "gram", "x", "number", "at")
    dealt.write.option("compression", "zstd").partitionBy("folder").parquet(path)
    return LabelIndex(spark, path)
