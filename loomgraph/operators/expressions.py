"""Class expressions over individuals, closed-world as for queries; each evaluates to a DataFrame with one column ``x``, a set."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import vocab as V
from loomgraph.functions import terms

_FACETS = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b}


class Expression:
    closed = False

    def find(self, triples: DataFrame) -> DataFrame:
        raise NotImplementedError

    def __and__(self, other: Expression) -> Expression:
        return And((self, other))

    def __or__(self, other: Expression) -> Expression:
        return Or((self, other))

    def __invert__(self) -> Expression:
        return Not(self)

    def closed_world(self) -> bool:
        """Whether the answer rests on what the graph doesn't say."""
        inner = [x for v in self.__dict__.values() for x in (v if isinstance(v, tuple) else [v]) if isinstance(x, Expression)]
        return self.closed or any(x.closed_world() for x in inner)


def universe(triples: DataFrame) -> DataFrame:
    """Individuals: IRIs and blank nodes with a type that is not a schema type, without what is used as schema."""
    is_type, below, meta = F.col("p") == V.TYPE, F.col("p") == V.SUBCLASS, F.col("o").isin(V.META)
    uses = [  # a term, whether it is an individual by this use, and whether it is schema
        (F.col("s"), is_type & ~meta & ~F.col("s").startswith('"'), is_type & meta | below), (F.col("p"), F.lit(False), F.lit(True)), (F.col("o"), F.lit(False), is_type & ~meta & F.col("o").startswith("<") | below),
    ]
    seen = triples.select(F.explode(F.array(*[F.struct(x.alias("x"), i.alias("individual"), m.alias("schema")) for x, i, m in uses])).alias("u")).select("u.*")
    return seen.filter("individual or schema").groupBy("x").agg(F.max("individual").alias("i"), F.max("schema").alias("m")).filter("i and not m").select("x")


@dataclass(frozen=True)
class Named(Expression):
    iri: str

    def find(self, triples: DataFrame) -> DataFrame:
        if self.iri == V.THING:
            return universe(triples)
        if self.iri == V.NOTHING:
            return triples.select(F.col("s").alias("x")).limit(0)
        return triples.filter((F.col("p") == V.TYPE) & (F.col("o") == self.iri)).select(F.col("s").alias("x")).distinct()


@dataclass(frozen=True)
class And(Expression):
    parts: tuple[Expression, ...]

    def find(self, triples: DataFrame) -> DataFrame:
        return reduce(lambda a, b: a.join(b, "x", "left_semi"), [p.find(triples) for p in self.parts])


@dataclass(frozen=True)
class Or(Expression):
    parts: tuple[Expression, ...]

    def find(self, triples: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, [p.find(triples) for p in self.parts]).distinct()


@dataclass(frozen=True)
class Not(Expression):
    part: Expression
    closed = True

    def find(self, triples: DataFrame) -> DataFrame:
        return universe(triples).join(self.part.find(triples), "x", "left_anti")


@dataclass(frozen=True)
class OneOf(Expression):
    members: tuple[str, ...]

    def find(self, triples: DataFrame) -> DataFrame:
        return triples.sparkSession.createDataFrame([(m,) for m in self.members], "x string").distinct()


@dataclass(frozen=True)
class Data(Expression):
    """Literals of a datatype, with facets such as (">=", 10); xsd:decimal takes any numeric literal. As a class it is empty."""

    datatype: str
    facets: tuple[tuple[str, float], ...] = ()

    def find(self, triples: DataFrame) -> DataFrame:
        return triples.select(F.col("s").alias("x")).limit(0)

    def test(self, term: Column) -> Column:
        own = terms.datatype(term).isin(terms.NUMERIC) if self.datatype == f"{V.XSD}decimal" else terms.datatype(term) == self.datatype
        return reduce(lambda a, f: a & F.coalesce(_FACETS[f[0]](terms.lex(term).try_cast("double"), F.lit(f[1])), F.lit(False)), self.facets, F.coalesce(own, F.lit(False)))


@dataclass(frozen=True)
class _Restriction(Expression):
    prop: str
    filler: Expression | None = None
    inverse: bool = False

    def pairs(self, triples: DataFrame) -> DataFrame:
        """(x, y): the property's pairs, the other way round for an inverse."""
        a, b = ("o", "s") if self.inverse else ("s", "o")
        return triples.filter(F.col("p") == self.prop).select(F.col(a).alias("x"), F.col(b).alias("y")).distinct()

    def filled(self, triples: DataFrame, negated: bool = False) -> DataFrame:
        """The pairs whose y is (or is not) in the filler."""
        pairs = self.pairs(triples)
        if self.filler is None or self.filler == Named(V.THING):
            return pairs.limit(0) if negated else pairs
        if isinstance(self.filler, Data):
            return pairs.filter(self.filler.test(F.col("y")) != F.lit(negated))
        return pairs.join(self.filler.find(triples).withColumnRenamed("x", "y"), "y", "left_anti" if negated else "left_semi").select("x", "y")


@dataclass(frozen=True)
class Some(_Restriction):
    def find(self, triples: DataFrame) -> DataFrame:
        return self.filled(triples).select("x").distinct()


@dataclass(frozen=True)
class Only(_Restriction):
    closed = True

    def find(self, triples: DataFrame) -> DataFrame:
        return universe(triples).join(self.filled(triples, negated=True).select("x"), "x", "left_anti")


@dataclass(frozen=True)
class Value(_Restriction):
    value: str = ""

    def find(self, triples: DataFrame) -> DataFrame:
        return self.pairs(triples).filter(F.col("y") == self.value).select("x").distinct()


@dataclass(frozen=True)
class Self(_Restriction):
    def find(self, triples: DataFrame) -> DataFrame:
        return self.pairs(triples).filter("x = y").select("x").distinct()


@dataclass(frozen=True)
class Min(_Restriction):
    """At least n different fillers. ``n`` = 0 gives those with a filler only, not the universe."""

    n: int = 1

    def counts(self, triples: DataFrame) -> DataFrame:
        return self.filled(triples).groupBy("x").agg(F.count("*").alias("n"))

    def find(self, triples: DataFrame) -> DataFrame:
        return self.counts(triples).filter(F.col("n") >= self.n).select("x")


@dataclass(frozen=True)
class Max(Min):
    closed = True

    def _over(self, triples: DataFrame) -> DataFrame:
        return universe(triples).join(self.counts(triples), "x", "left").withColumn("n", F.coalesce("n", F.lit(0)))

    def find(self, triples: DataFrame) -> DataFrame:
        return self._over(triples).filter(F.col("n") <= self.n).select("x")


@dataclass(frozen=True)
class Exactly(Max):
    def find(self, triples: DataFrame) -> DataFrame:
        return self._over(triples).filter(F.col("n") == self.n).select("x")


def instances(expression: Expression, triples: DataFrame) -> DataFrame:
    """The members in the order of their output form."""
    return expression.find(triples).orderBy(terms.compat(F.col("x")))


def related_classes(triples: DataFrame, classes: list[str]) -> DataFrame:
    """(relation, x) for a named class, or for the conjunction of several: super (of any), sub (of all), equivalent (of a single one), as stored; without blank nodes and the classes themselves."""
    named = ~F.col("x").startswith("_:") & ~F.col("x").isin(classes)
    above = triples.filter((F.col("p") == V.SUBCLASS) & F.col("s").isin(classes)).select(F.lit("super").alias("relation"), F.col("o").alias("x")).distinct()
    below = triples.filter((F.col("p") == V.SUBCLASS) & F.col("o").isin(classes)).groupBy(F.col("s").alias("x")).agg(F.countDistinct("o").alias("n")).filter(F.col("n") == len(set(classes))).select(F.lit("sub").alias("relation"), "x")
    out = above.unionByName(below)
    if len(classes) == 1:
        same = triples.filter(F.col("p") == V.EQUIVALENT).select(F.explode(F.array(F.struct(F.col("s").alias("a"), F.col("o").alias("x")), F.struct(F.col("o").alias("a"), F.col("s").alias("x")))).alias("e")).select("e.a", "e.x")
        out = out.unionByName(same.filter(F.col("a") == classes[0]).select(F.lit("equivalent").alias("relation"), "x").distinct())
    return out.filter(named)
