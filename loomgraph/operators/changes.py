"""Change logs of triples and edits that give them: (seq, batch, op, s, p, o), op being add or remove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph import vocab as V
from loomgraph.functions import terms
from loomgraph.plans.shared import cut


def apply_batch(triples: DataFrame, log: DataFrame) -> DataFrame:
    """One batch as a whole, without an order: its removals first, then its additions."""
    cols = ["s", "p", "o"]
    removed, added = (log.filter(F.col("op") == op).select(*cols) for op in ("remove", "add"))
    return triples.select(*cols).join(removed, cols, "left_anti").unionByName(added).distinct()


def replay(start: DataFrame, log: DataFrame, until_batch: int | None = None, removes_first: bool = False) -> DataFrame:
    """The triples after the batches up to ``until_batch`` (all by default): for each triple the last change counts; with
    ``removes_first`` the removals of a batch come before its additions, whatever their ``seq``."""
    kept = log if until_batch is None else log.filter(F.col("batch") <= until_batch)
    when = F.struct("batch", F.when(F.col("op") == "add", 1).otherwise(0), "seq") if removes_first else F.col("seq")
    last = kept.groupBy("s", "p", "o").agg(F.max_by("op", when).alias("op"))
    return start.select("s", "p", "o").distinct().join(last, ["s", "p", "o"], "left_anti").unionByName(last.filter("op = 'add'").select("s", "p", "o"))


def undo(current: DataFrame, log: DataFrame, batches: int = 1) -> DataFrame:
    """``current`` with the last batches reversed, newest first. A change that changed nothing is reversed all the same: undoing
    an addition removes the triple even if it was there before."""
    latest = log.select("batch").distinct().orderBy(F.desc("batch")).limit(batches)
    back = log.join(F.broadcast(latest), "batch", "left_semi")
    first = back.groupBy("s", "p", "o").agg(F.min_by("op", "seq").alias("op"))
    return current.select("s", "p", "o").join(first, ["s", "p", "o"], "left_anti").unionByName(first.filter("op = 'remove'").select("s", "p", "o")).distinct()


def redo(current: DataFrame, log: DataFrame, undone: int, batches: int = 1) -> DataFrame:
    """``current``, from which the last ``undone`` batches were undone, with the first ``batches`` of those applied again."""
    numbers = log.select("batch").distinct().orderBy(F.desc("batch")).limit(undone).orderBy("batch").limit(batches)
    again = log.join(F.broadcast(numbers), "batch", "left_semi")
    return replay(current, again)


def after_change(log: DataFrame, undone: int, change: DataFrame) -> DataFrame:
    """The log once a new change (op, s, p, o) follows ``undone`` undone batches: those can't be redone any more."""
    numbers = log.select("batch").distinct().orderBy(F.desc("batch")).limit(undone)
    kept = cut(log.join(F.broadcast(numbers), "batch", "left_anti"))
    at = kept.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("last"), F.coalesce(F.max("batch"), F.lit(-1)).alias("latest"))
    place = F.row_number().over(Window.orderBy("op", "s", "p", "o"))  # of one change's rows
    return kept.unionByName(change.crossJoin(F.broadcast(at)).select((F.col("last") + place).alias("seq"), (F.col("latest") + 1).alias("batch"), "op", "s", "p", "o"))


def replace_source(asserted: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triples, changes): ``asserted`` becomes the set ``new`` in one batch; reason in full afterwards."""
    return new.select("s", "p", "o").distinct(), difference(asserted, new)


def reset(triples: DataFrame) -> DataFrame:
    """No triples, as at the beginning."""
    return triples.limit(0)


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(op, s, p, o): what turns the set of triples ``old`` into ``new``."""
    cols = ["s", "p", "o"]
    added = new.select(*cols).distinct().join(old, cols, "left_anti").select(F.lit("add").alias("op"), *cols)
    return added.unionByName(old.select(*cols).distinct().join(new, cols, "left_anti").select(F.lit("remove").alias("op"), *cols))


def rename(triples: DataFrame, old: str, new: str) -> DataFrame:
    """``old`` replaced by ``new`` as subject, predicate and object; refused (ValueError) where ``new`` has a type already."""
    if not triples.filter((F.col("s") == new) & (F.col("p") == V.TYPE)).isEmpty():
        raise ValueError(f"{new} exists")
    swap = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c)).alias(c)
    return triples.select(*[swap(c) for c in "spo"]).distinct()


def delete_entity(triples: DataFrame, entity: Column | str) -> DataFrame:
    """Without the triples that have the entity as subject or object; as predicate it stays."""
    return triples.filter((F.col("s") != entity) & (F.col("o") != entity))


def relabel(triples: DataFrame, entity: str, label: str) -> DataFrame:
    """All labels of an entity replaced by one plain literal."""
    kept = triples.filter(~((F.col("s") == entity) & (F.col("p") == V.LABEL)))
    return kept.unionByName(kept.sparkSession.range(1).select(F.lit(entity).alias("s"), F.lit(V.LABEL).alias("p"), terms.literal(F.lit(label)).alias("o")))


def structure(triples: DataFrame, roots: DataFrame, max_depth: int = 1000) -> DataFrame:
    """The triples of blank nodes that hang on the blank nodes ``roots`` (x), followed through nodes that one triple points to only."""
    shared = triples.filter(F.col("o").startswith("_:")).groupBy("o").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("o").alias("x"))
    fresh = cut(roots.filter(F.col("x").startswith("_:")).select("x").distinct())
    found = fresh
    for _ in range(max_depth):
        owned = triples.join(fresh.select(F.col("x").alias("s")), "s", "left_semi").filter(F.col("o").startswith("_:")).select(F.col("o").alias("x")).distinct()
        fresh = cut(owned.join(shared, "x", "left_anti").join(found, "x", "left_anti"))
        if fresh.isEmpty():
            return triples.join(found.select(F.col("x").alias("s")), "s", "left_semi").select("s", "p", "o")
        found = found.unionByName(fresh)
    raise RuntimeError(f"blank nodes nest deeper than {max_depth}")
