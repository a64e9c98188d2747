"""Edits as changes (op, s, p, o), to be applied by ``changes.apply_batch`` or put into a log."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import vocab as V
from loomgraph.operators.changes import structure
from loomgraph.plans.shared import cut
from loomgraph.sources.rdf import literal

# Characters that an IRI may not hold, the characteristics of properties, annotation properties whose URLs are links.
FORBIDDEN = set('<>"{}|\\^`')
CHARACTERISTICS = ("Functional", "InverseFunctional", "Transitive", "Symmetric", "Asymmetric", "Reflexive", "Irreflexive")
LINKS = {V.rdfs("seeAlso"), V.rdfs("isDefinedBy"), "<http://purl.org/dc/terms/source>"}
_SCHEMA = "op string, s string, p string, o string"


def changed(spark: SparkSession, *rows: tuple[str, str, str, str]) -> DataFrame:
    return spark.createDataFrame(list(rows), _SCHEMA)


def checked_iri(iri: str) -> str:
    """A bare IRI as a term; ValueError says what is wrong with it."""
    bad = sorted({c for c in iri if c in FORBIDDEN or ord(c) <= 0x20})
    if bad:
        raise ValueError(f"an IRI can't hold {bad}")
    if ":" not in iri:
        raise ValueError("an IRI needs a scheme")
    return f"<{iri}>"


def add_individual(spark: SparkSession, individual: str, cls: str) -> DataFrame:
    return changed(spark, ("add", individual, V.TYPE, cls))


def add_class(spark: SparkSession, cls: str) -> DataFrame:
    return changed(spark, ("add", cls, V.TYPE, V.CLASS))


def add_subclass(spark: SparkSession, cls: str, above: str) -> DataFrame:
    return changed(spark, ("add", cls, V.SUBCLASS, above))


def add_object_property(spark: SparkSession, prop: str) -> DataFrame:
    return changed(spark, ("add", prop, V.TYPE, V.OBJECT_PROPERTY))


def add_data_property(spark: SparkSession, prop: str) -> DataFrame:
    return changed(spark, ("add", prop, V.TYPE, V.DATA_PROPERTY))


def add_subproperty(spark: SparkSession, prop: str, above: str) -> DataFrame:
    return changed(spark, ("add", prop, V.SUBPROPERTY, above))


def axiom_removal(triples: DataFrame, axiom: tuple[str, str, str]) -> DataFrame:
    """The axiom's triple and, if it points at a blank node, the structure that hangs on that node alone."""
    whole = triples.filter((F.col("s") == axiom[0]) & (F.col("p") == axiom[1]) & (F.col("o") == axiom[2])).select("s", "p", "o")
    if axiom[2].startswith("_:"):
        whole = whole.unionByName(structure(triples, triples.sparkSession.createDataFrame([(axiom[2],)], "x string")))
    return whole.distinct().select(F.lit("remove").alias("op"), "s", "p", "o")


def unused_iri(triples: DataFrame, iri: str) -> str:
    """``iri`` (bare), or that with the first number from 2 behind it that makes it new to the graph."""
    tail = F.regexp_extract("x", re.escape(f"<{iri}") + r"(?:_([1-9]\d{0,17}))?>$", 1)
    named = triples.select(F.explode(F.array("s", "p", "o")).alias("x")).filter(F.col("x").startswith(f"<{iri}") & F.col("x").rlike(re.escape(f"<{iri}") + r"(_[1-9]\d{0,17})?>$"))
    taken = cut(named.select(F.when(tail == "", 1).otherwise(tail.cast("long")).alias("k")).distinct())
    # the first number behind a taken one that is not taken itself
    free = taken.select((F.col("k") + 1).alias("k")).join(taken, "k", "left_anti").filter("k > 1").agg(F.min("k").alias("free"))
    row = taken.agg(F.max(F.col("k") == 1).alias("bare"), F.max(F.col("k") == 2).alias("two")).crossJoin(F.broadcast(free)).collect()[0]
    return f"<{iri}>" if not row["bare"] else f"<{iri}_{row['free'] if row['two'] else 2}>"


def edit_value(spark: SparkSession, s: str, p: str, old: str, new: str) -> list[DataFrame]:
    """Two changes, one after the other, each undone by itself."""
    return [changed(spark, ("remove", s, p, old)), changed(spark, ("add", s, p, new))]


def toggle_characteristic(triples: DataFrame, prop: str, characteristic: str) -> DataFrame:
    """Adds the characteristic to a property, or removes it where it is there; data properties can be functional only."""
    if characteristic not in CHARACTERISTICS:
        raise ValueError(f"no characteristic {characteristic!r}")
    typed = lambda cls: not triples.filter((F.col("s") == prop) & (F.col("p") == V.TYPE) & (F.col("o") == cls)).isEmpty()
    if characteristic != "Functional" and typed(V.DATA_PROPERTY):
        raise ValueError("a data property can be functional only")
    cls = V.owl(f"{characteristic}Property")
    return changed(triples.sparkSession, ("remove" if typed(cls) else "add", prop, V.TYPE, cls))


def add_annotation(spark: SparkSession, entity: str, prop: str, value: str, lang: str | None = None) -> DataFrame:
    """A URL given to a linking property becomes an IRI, anything else a literal."""
    link = prop in LINKS and re.match(r"https?://\S+$", value)
    return changed(spark, ("add", entity, prop, checked_iri(value) if link else literal(value, lang=lang)))
