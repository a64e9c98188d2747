"""Sameness by representatives: reasoning keeps one term of each group of the same individuals, and expands to all of them only on demand.

The closure of sameAs has a row for each two members of a group, and a copy of each of their triples for each member. Here a group of n has n
rows (x, same) and its triples once, over the smallest member; ``expand`` gives the closure's rows for what is asked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import vocab as V
from loomgraph.operators.patterns import Pattern
from loomgraph.operators.rules import GROUPS, infer
from loomgraph.plans.components import components
from loomgraph.plans.shared import attach, hub_join, staged

_VOCABULARY = "^<(" + "|".join(x.replace(".", r"\.") for x in (V.RDF, V.RDFS, V.OWL)) + ")"


@dataclass(frozen=True)
class Merged:
    """``triples``: (s, p, o, level, rule) over representatives, with one sameAs triple from each to itself. ``members``: (x, same) of every
    term that is the same as another, ``same`` being the representative, also for the representative."""

    triples: DataFrame
    members: DataFrame

    def pattern(self, pattern: Pattern) -> Pattern:
        """A pattern for ``triples``: its constants by their representatives."""
        constants = [x for x in pattern if not x.startswith("?")]
        known = {r["x"]: r["same"] for r in self.members.filter(F.col("x").isin(constants)).collect()} if constants else {}
        return tuple(known.get(x, x) for x in pattern)

    def expand(self, solutions: DataFrame, columns: list[str]) -> DataFrame:
        """Solutions over representatives with every member in place of its representative, in the given columns; unbound ones stay."""
        names = solutions.columns
        for c in columns:
            own = self.members.select(F.col("same").alias(c), F.col("x").alias("_x"))
            single = solutions.join(self.members.select(F.col("same").alias(c)).distinct(), c, "left_anti")
            solutions = single.unionByName(hub_join(solutions, own, [c]).withColumn(c, F.col("_x")).select(*names))
        return solutions.select(*names)

    def closure(self) -> DataFrame:
        """(s, p, o) of all triples that reasoning with the rules of sameness would derive: as many rows as they have."""
        return self.expand(self.triples.select("s", "p", "o"), ["s", "p", "o"]).distinct()


def _rewritten(triples: DataFrame, members: DataFrame) -> DataFrame:
    """Each part of each triple by its representative; terms with very many triples are looked up by ``attach``."""
    for c in "spo":
        counted = staged(triples.groupBy(c).agg(F.count("*").alias("_n")).join(members.select(F.col("x").alias(c), F.col("same").alias("_same")), c))
        if counted.isEmpty():
            continue
        triples = attach(triples, counted, c, "_n", F.struct("s", "p", "o")).withColumn(c, F.coalesce("_same", c)).drop("_same", "_n")
    return triples


def infer_merged(given: DataFrame, groups: tuple[str, ...] = GROUPS, only: set[str] | None = None, max_rounds: int = 20) -> Merged:
    """What ``infer`` with the rules of sameness entails, by representatives.

    Rounds: all rules but those of sameness to their fixpoint; groups of what came out as the same; triples rewritten to
    representatives, of which only changed ones are new to the next round. ``level`` counts on over the rounds. A term of the RDF vocabulary stands for its
    group; two of them in one are refused (ValueError), as rules could not name both.
    """
    rest = tuple(g for g in groups if g != "equality")
    base = staged(given.select("s", "p", "o").dropna().distinct().select("s", "p", "o", F.lit(0).alias("level"), F.lit(None).cast("string").alias("rule")))
    members, start, fresh, level = None, None, base, 0
    for _ in range(max_rounds):
        found = infer(fresh.select("s", "p", "o"), rest, only, start=start)
        # those that went in keep their level and rule; what was derived from them comes after all that was there
        known = fresh.select("s", "p", "o", F.col("level").alias("_level"), F.col("rule").alias("_rule"), F.lit(True).alias("_in"))
        if start is not None:
            known = known.unionByName(start.select("s", "p", "o", F.col("level").alias("_level"), F.col("rule").alias("_rule"), F.lit(True).alias("_in")))
        found = found.select("s", "p", "o", "level", "rule").join(known, ["s", "p", "o"], "left")
        triples = staged(found.select("s", "p", "o", F.when(F.col("_in"), F.col("_level")).otherwise(F.col("level") + level).alias("level"), F.when(F.col("_in"), F.col("_rule")).otherwise(F.col("rule")).alias("rule")))
        same = triples.filter((F.col("p") == V.SAME) & (F.col("s") != F.col("o")))
        if same.isEmpty():
            none = given.limit(0).select(F.col("s").alias("x"), F.col("s").alias("same"))
            return Merged(triples, none if members is None else members)
        grouped = components(same, "s", "o")
        special = grouped.filter(F.col("node").rlike(_VOCABULARY)).groupBy("component").agg(F.min("node").alias("first"), F.count("*").alias("n"))
        special = staged(special)
        if not special.filter("n > 1").isEmpty():
            raise ValueError("terms of the RDF vocabulary are the same as each other")
        grouped = staged(grouped.join(special.select("component", "first"), "component", "left").select(F.col("node").alias("x"), F.coalesce("first", "component").alias("same")))
        members = grouped if members is None else staged(_chained(members, grouped))
        whole = _rewritten(triples.filter(~((F.col("p") == V.SAME) & (F.col("s") != F.col("o")))), grouped)
        level = triples.agg(F.max("level")).collect()[0][0] + 1
        own = grouped.select("same").distinct().select(F.col("same").alias("s"), F.lit(V.SAME).alias("p"), F.col("same").alias("o"), F.lit(level).alias("level"), F.lit("eq-trans").alias("rule"))
        whole = whole.unionByName(own).groupBy("s", "p", "o").agg(F.min(F.struct("level", "rule")).alias("b")).select("s", "p", "o", "b.level", "b.rule")
        marked = staged(whole.join(triples.select("s", "p", "o", F.lit(True).alias("_kept")), ["s", "p", "o"], "left"))
        start, fresh = marked.filter("_kept").drop("_kept"), marked.filter("_kept is null").drop("_kept")
    raise RuntimeError(f"sameness did not settle in {max_rounds} rounds")


def _chained(members: DataFrame, grouped: DataFrame) -> DataFrame:
    """Earlier members by their representatives' own, and the new ones."""
    moved = members.join(grouped.select(F.col("x").alias("same"), F.col("same").alias("_to")), "same", "left").select("x", F.coalesce("_to", "same").alias("same"))
    return moved.unionByName(grouped.join(members.select("x"), "x", "left_anti"))


def same_pairs(merged: Merged, terms: DataFrame) -> DataFrame:
    """(x, y): for the asked terms (x), all that they are the same as, themselves included where they are in a group."""
    own = terms.select("x").distinct().join(merged.members, "x")
    return hub_join(own, merged.members.select(F.col("x").alias("y"), "same"), ["same"]).select("x", "y")

