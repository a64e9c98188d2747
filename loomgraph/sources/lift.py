"""Direct mapping of relational tables to triples: a row is a subject, columns are properties."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import vocab as V
from loomgraph.functions import terms
from loomgraph.plans.shared import table

BASE = "http://ex.org/"


def name(local: str) -> str:
    return f"<{BASE}{local}>"


def entity(kind: str, *keys: Column) -> Column:
    return terms.iri(f"{BASE}{kind}/", *[x for i, k in enumerate(keys) for x in ([F.lit("-"), k] if i else [k])])


@dataclass(frozen=True)
class Mapping:
    """One table: how rows are named, their class, and a term for each property. Only columns that are named are read. ``keyed``: no
    two rows have one subject and no other mapping gives its triples, so they need not be compared."""

    table: str
    subject: Column
    cls: str | None = None
    properties: dict[str, Column] = field(default_factory=dict)
    keyed: bool = False


def lift(spark: SparkSession, sf_dir: str, mappings: list[Mapping]) -> DataFrame:
    """The set of triples of the mappings; null values give no triple."""
    parts: dict[bool, list[DataFrame]] = {True: [], False: []}
    for m in mappings:
        rows = table(spark, sf_dir, m.table)
        cells = [F.struct(F.lit(V.TYPE).alias("p"), F.lit(m.cls).alias("o"))] if m.cls else []
        cells += [F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in m.properties.items()]
        parts[m.keyed].append(rows.select(m.subject.alias("s"), F.explode(F.array(*cells)).alias("c")).select("s", "c.p", "c.o"))
    whole = parts[True] + ([reduce(DataFrame.unionByName, parts[False]).distinct()] if parts[False] else [])
    return reduce(DataFrame.unionByName, whole).dropna()


def triples(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    """Schema triples written out."""
    return spark.createDataFrame(rows, "s string, p string, o string")


def rdf_list(head: str, items: list[str]) -> list[tuple[str, str, str]]:
    """The cells of an RDF list that begins at ``head``."""
    cells = [head, *[f"{head}_{i}" for i in range(1, len(items))]]
    return [t for i, item in enumerate(items) for t in ((cells[i], V.FIRST, item), (cells[i], V.REST, cells[i + 1] if i + 1 < len(items) else V.NIL))]
