"""Graph-pattern algebra over triples (s, p, o): solutions are DataFrames with a column for each variable.

Variables are strings that start with ``?``; anything else is a term key. Null is "unbound". Solutions are bags. Columns of ``scan`` are
marked as bound, and keep the mark through selections, filters and inner joins; the functions here that may unbind a variable take the mark away.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.plans.layout import with_predicates
from loomgraph.plans.shared import cut, hub_join, staged

Pattern = tuple[str, str, str]
T = TypeVar("T")
#: From so many pairs on, steps of paths split nodes that many pairs meet at; fewer have none that a task could not take.
MANY = 100_000


#: A column's metadata where its variable is bound in every solution.
_BOUND = {"bound": True}


def unsure(solutions: DataFrame) -> set[str]:
    """The variables that may be unbound, as far as their columns say. An outer join that is made elsewhere keeps its columns' marks, so what it
    leaves unbound must be named in ``maybe``."""
    return {f.name for f in solutions.schema.fields if f.nullable and not f.metadata.get("bound")}


def scan(triples: DataFrame, pattern: Pattern, carry: dict[str, str] | None = None) -> DataFrame:
    """Solutions of one pattern; constants filter the scan, a repeated variable is an equality. ``carry``: further columns and their names."""
    out, seen = triples, {}
    if not pattern[1].startswith("?"):
        out = with_predicates(out, [pattern[1]])
    for column, part in zip("spo", pattern, strict=True):
        if not part.startswith("?"):
            out = out.filter(F.col(column) == part)
        elif part in seen:
            out = out.filter(F.col(column) == F.col(seen[part]))
        else:
            seen[part] = column
    return out.select(*[F.col(c).alias(v[1:], metadata=_BOUND) for v, c in seen.items()], *[F.col(c).alias(n) for c, n in (carry or {}).items()])


def join(left: DataFrame, right: DataFrame, hubs: bool = False) -> DataFrame:
    """Solutions that agree on the shared variables, which must be bound. ``hubs``: one value may have a large share of both sides' rows."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError(f"no shared variable: {left.columns} and {right.columns}")
    return hub_join(left, right, shared) if hubs else left.join(right, shared)


def bgp(triples: DataFrame, patterns: list[Pattern], hubs: bool = False) -> DataFrame:
    """A basic graph pattern. Patterns are joined in the order given, each with one that it shares a variable with. Patterns that hang apart
    are refused: their solutions are all pairs, which ``join`` never makes."""
    rest = list(patterns)
    out = scan(triples, rest.pop(0))
    while rest:
        k = next((i for i, p in enumerate(rest) if {v[1:] for v in p if v.startswith("?")} & set(out.columns)), 0)
        out = join(out, scan(triples, rest.pop(k)), hubs)
    return out


def _shared(left: DataFrame, right: DataFrame, maybe: set[str] | frozenset[str] | None) -> tuple[list[str], list[str]]:
    """The shared variables that are bound on both sides, and those that may not be."""
    open_ = unsure(left) | unsure(right) if maybe is None else set(maybe)
    shared = [c for c in left.columns if c in right.columns]
    return [c for c in shared if c not in open_], [c for c in shared if c in open_]


def _compatible(left: DataFrame, right: DataFrame, sure: list[str], loose: list[str], disjoint: bool) -> Iterator[tuple[DataFrame, Column]]:
    """(some of ``right`` with the shared variables as _r_..., when a left row is compatible with one): an equality join for each set of the
    ``loose`` variables that right rows have bound; together they hold every compatible pair once. Right rows of a set are there for each
    part of it that a left row may have bound. ``disjoint``: also pairs without a variable that both have bound, which are all pairs of such rows."""
    renamed = reduce(lambda df, c: df.withColumnRenamed(c, f"_r_{c}"), [*sure, *loose], right)
    for mask in range(1 << len(loose)):
        held = [c for i, c in enumerate(loose) if mask >> i & 1]
        if not (sure or held or disjoint):
            continue
        rows = reduce(lambda df, c: df.filter(F.col(f"_r_{c}").isNotNull() if c in held else F.col(f"_r_{c}").isNull()), loose, renamed)
        on = [left[c] == rows[f"_r_{c}"] for c in sure]
        if held:
            parts = [k for k in range(1 << len(held)) if k or sure or disjoint]
            rows = rows.withColumn("_part", F.explode(F.array(*map(F.lit, parts))))
            own = reduce(lambda a, b: a + b, [F.when(left[c].isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(held)])
            on.append(own == rows["_part"])
            for i, c in enumerate(held):
                # null where the left row has it unbound: equal then as well
                rows = rows.withColumn(f"_m_{c}", F.when(F.col("_part").bitwiseAND(1 << i) > 0, F.col(f"_r_{c}")))
                on.append(left[c].eqNullSafe(F.col(f"_m_{c}")))
        yield rows, reduce(lambda a, b: a & b, on) if on else F.lit(True)


def optional(left: DataFrame, right: DataFrame, condition: Column | None = None, maybe: set[str] | frozenset[str] | None = None) -> DataFrame:
    """OPTIONAL: every left solution, with the right ones that agree (and meet ``condition``). ``maybe``: shared variables that may be unbound, by
    default those whose columns don't say that they are bound. A solution agrees with all whose bound variables it has unbound."""
    sure, loose = _shared(left, right, maybe)
    if not sure and not loose:
        raise ValueError("OPTIONAL without a shared variable")
    extra = [c for c in right.columns if c not in left.columns]
    if not loose:
        renamed, on = next(_compatible(left, right, sure, loose, True))
        out = left.join(renamed, on if condition is None else on & condition, "left")
        return out.select(*[left[c] for c in left.columns], *[renamed[c].alias(c, metadata={}) for c in extra])
    parts = []
    for rows, on in _compatible(left, right, sure, loose, True):
        met = left.join(rows, on if condition is None else on & condition)
        parts.append(met.select(*[left[c].alias(f"_l_{c}") for c in left.columns], *[F.coalesce(left[c], rows[f"_r_{c}"]).alias(c) if c in loose else left[c] for c in left.columns], *[rows[c].alias(c, metadata={}) for c in extra]))
    met = reduce(DataFrame.unionByName, parts)
    # equal left rows have equal partners, so a row's values say whether it met any
    found = met.select(*[f"_l_{c}" for c in left.columns]).distinct()
    alone = left.join(found, reduce(lambda a, b: a & b, [left[c].eqNullSafe(found[f"_l_{c}"]) for c in left.columns]), "left_anti")
    return met.select(*left.columns, *extra).unionByName(alone, allowMissingColumns=True)


def minus(left: DataFrame, right: DataFrame, maybe: set[str] | frozenset[str] | None = None) -> DataFrame:
    """MINUS: without the solutions that agree with a right one and have a variable bound that it has bound as well. ``maybe`` as in ``optional``."""
    sure, loose = _shared(left, right, maybe)
    for rows, on in _compatible(left, right, sure, loose, False):
        left = left.join(rows, on, "left_anti")
    return left


def exists(left: DataFrame, right: DataFrame, negated: bool = False, maybe: set[str] | frozenset[str] | None = None) -> DataFrame:
    """FILTER EXISTS, or NOT EXISTS: solutions that agree with a right one, or with none. ``maybe`` as in ``optional``."""
    sure, loose = _shared(left, right, maybe)
    if not sure and not loose:
        return left.limit(0) if right.isEmpty() != negated else left
    if not loose:
        rows, on = next(_compatible(left, right, sure, loose, True))
        return left.join(rows, on, "left_anti" if negated else "left_semi")
    found, rest = [], left
    for rows, on in _compatible(left, right, sure, loose, True):
        if not negated:
            found.append(rest.join(rows, on, "left_semi"))
        rest = rest.join(rows, on, "left_anti")
    return rest if negated else reduce(DataFrame.unionByName, found)


def union(*parts: DataFrame) -> DataFrame:
    """UNION: the bag of all solutions; variables that a part lacks are unbound in it."""
    names = list(dict.fromkeys(c for p in parts for c in p.columns))
    open_ = {c for p in parts for c in names if c not in p.columns or c in unsure(p)}
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select(*[F.col(c).alias(c, metadata={} if c in open_ else _BOUND) for c in names])


def values(solutions: DataFrame, rows: list[dict[str, str | None]]) -> DataFrame:
    """VALUES joined to solutions; None (UNDEF) agrees with anything, and so does an unbound variable."""
    names = list(dict.fromkeys(n for r in rows for n in r))
    given = solutions.sparkSession.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))
    sure, loose = _shared(solutions, given, {n for n in names if any(r.get(n) is None for r in rows)} | unsure(solutions))
    extra = [n for n in names if n not in solutions.columns]
    parts = []
    for rows_, on in _compatible(solutions, given, sure, loose, True):
        met = solutions.join(F.broadcast(rows_), on)
        parts.append(met.select(*[F.coalesce(solutions[c], rows_[f"_r_{c}"]).alias(c) if c in loose else solutions[c] for c in solutions.columns], *[rows_[n] for n in extra]))
    return reduce(DataFrame.unionByName, parts)


def construct(solutions: DataFrame, template: list[Pattern]) -> DataFrame:
    """CONSTRUCT: the set of the template's triples; triples with an unbound part or a literal subject are left out. A blank node of the
    template (``_:x``) is a new one for each solution; solutions that are equal share theirs."""
    row = F.sha2(F.to_json(F.struct(*solutions.columns), {"ignoreNullFields": "false"}), 256) if any(x.startswith("_:") for t in template for x in t) else None
    cell = lambda part: F.col(part[1:]) if part.startswith("?") else F.concat(F.lit(f"{part}-"), row) if part.startswith("_:") else F.lit(part)
    parts = [solutions.select(*[cell(x).alias(c) for c, x in zip("spo", t, strict=True)]) for t in template]
    return reduce(DataFrame.unionByName, parts).filter("s is not null and p is not null and o is not null and not startswith(s, '\"')").distinct()


def capped(solutions: DataFrame, rows: int = 10_000) -> tuple[DataFrame, bool]:
    """The first rows, and whether there are more."""
    some = cut(solutions.limit(rows + 1))
    return some.limit(rows), some.count() > rows


def within(spark: SparkSession, seconds: float, work: Callable[[], T]) -> T:
    """What ``work`` gives, or TimeoutError: Spark's jobs that it has begun are cancelled after so many seconds."""
    tag, late = f"loomgraph-{uuid.uuid4().hex}", []

    def stop() -> None:
        late.append(True)
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        return work()
    except Exception as e:
        if late:
            raise TimeoutError(f"no result in {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def dataset(reasoned: DataFrame, main: bool = True) -> DataFrame:
    """What a query runs over: everything, or only what was asserted or imported."""
    return (reasoned if main else reasoned.filter("level = 0")).select("s", "p", "o")


def named_graph(triples: DataFrame, graph: str) -> DataFrame:
    """GRAPH and FROM NAMED: there is one graph without a name, so a named one is empty, whatever its name."""
    return triples.limit(0)


def ask(solutions: DataFrame) -> DataFrame:
    """ASK: one row with ``answer``."""
    return solutions.limit(1).agg((F.count("*") > 0).alias("answer"))


def describe(triples: DataFrame, resources: DataFrame, max_depth: int = 50) -> DataFrame:
    """DESCRIBE: triples with a resource (column ``s``) as subject, and those of the blank nodes that hang on it."""
    found = cut(triples.join(resources.select("s").distinct(), "s", "left_semi").select("s", "p", "o"))
    fresh = found
    for _ in range(max_depth):
        nodes = fresh.filter(F.col("o").startswith("_:")).select(F.col("o").alias("s")).distinct().join(found.select("s").distinct(), "s", "left_anti")
        fresh = cut(triples.join(nodes, "s", "left_semi").select("s", "p", "o"))
        if fresh.isEmpty():
            return found
        found = found.unionByName(fresh)
    raise RuntimeError(f"blank nodes nest deeper than {max_depth}")


def step(triples: DataFrame, path: str | tuple) -> DataFrame:
    """Pairs (a, b) of a property path: an IRI; ("inv", p); ("seq", p, q, ...); ("alt", p, q, ...); ("not", iri, ...);
    ("plus", p); ("star", p); ("opt", p). The last three are sets; the zero-length part of star and opt is every subject and object."""
    if isinstance(path, str):
        return with_predicates(triples, [path]).filter(F.col("p") == path).select(F.col("s").alias("a"), F.col("o").alias("b"))
    kind, *parts = path
    if kind == "inv":
        return step(triples, parts[0]).select(F.col("b").alias("a"), F.col("a").alias("b"))
    if kind == "seq":
        return reduce(lambda x, y: x.withColumnRenamed("b", "m").join(y.withColumnRenamed("a", "m"), "m").select("a", "b"), [step(triples, p) for p in parts])
    if kind == "alt":
        return reduce(DataFrame.unionByName, [step(triples, p) for p in parts])
    if kind == "not":
        return triples.filter(~F.col("p").isin(parts)).select(F.col("s").alias("a"), F.col("o").alias("b"))
    pairs = closure(step(triples, parts[0])) if kind in ("plus", "star") else step(triples, parts[0]).distinct()
    if kind == "plus":
        return pairs
    if kind not in ("star", "opt"):
        raise ValueError(f"unknown path {kind!r}")
    nodes = triples.select("s").union(triples.select("o")).distinct()
    return pairs.unionByName(nodes.select(F.col("s").alias("a"), F.col("s").alias("b"))).distinct()


def _reversed(path: str | tuple) -> str | tuple:
    """The path from its end to its beginning."""
    if isinstance(path, str):
        return ("inv", path)
    kind, *parts = path
    if kind == "inv":
        return parts[0]
    if kind == "not":
        return ("inv", path)
    return (kind, *map(_reversed, reversed(parts) if kind == "seq" else parts))


def _reach(triples: DataFrame, path: str | tuple, nodes: DataFrame, max_rounds: int) -> DataFrame:
    """(a, b): for each of the distinct ``nodes`` (a), what a path of one step or more along ``path`` reaches; a set. Each round looks at the last
    round's ends only."""
    known = None
    fresh = _follow(triples, path, nodes.select("a", F.col("a").alias("b")), max_rounds).distinct()
    for _ in range(max_rounds):
        fresh = staged(fresh)
        if fresh.isEmpty():
            return fresh if known is None else known
        known = fresh if known is None else known.unionByName(fresh)
        ahead = fresh.select(F.col("b").alias("a")).distinct()
        steps = _follow(triples, path, ahead.select("a", F.col("a").alias("b")), max_rounds).distinct().select(F.col("a").alias("m"), F.col("b").alias("to"))
        meet = hub_join if fresh.count() > MANY else lambda x, y, on: x.join(y, on)
        fresh = meet(fresh.withColumnRenamed("b", "m"), steps, ["m"]).select("a", F.col("to").alias("b")).distinct().join(known, ["a", "b"], "left_anti")
    raise RuntimeError(f"the path did not end in {max_rounds} rounds")


def _follow(triples: DataFrame, path: str | tuple, pairs: DataFrame, max_rounds: int) -> DataFrame:
    """``pairs`` (a, b) gone on from b along the path: (a, b)."""
    if isinstance(path, str) or path[0] in ("inv", "not"):
        if not isinstance(path, str) and path[0] == "inv" and not isinstance(path[1], str) and path[1][0] != "not":
            return _follow(triples, _reversed(path[1]), pairs, max_rounds)
        edges = step(triples, path).select(F.col("a").alias("b"), F.col("b").alias("to"))
        near = edges.join(pairs.select("b").distinct(), "b", "left_semi")
        return pairs.join(near, "b").select("a", F.col("to").alias("b"))
    kind, *parts = path
    if kind == "seq":
        return reduce(lambda found, p: _follow(triples, p, found, max_rounds), parts, pairs)
    if kind == "alt":
        return reduce(DataFrame.unionByName, [_follow(triples, p, pairs, max_rounds) for p in parts])
    if kind not in ("plus", "star", "opt"):
        raise ValueError(f"unknown path {kind!r}")
    nodes = pairs.select(F.col("b").alias("a")).distinct()
    own = nodes.select("a", F.col("a").alias("b"))
    reached = _follow(triples, parts[0], own, max_rounds).distinct() if kind == "opt" else _reach(triples, parts[0], nodes, max_rounds)
    if kind != "plus":
        reached = reached.unionByName(own).distinct()
    return pairs.join(reached.select(F.col("a").alias("b"), F.col("b").alias("to")), "b").select("a", F.col("to").alias("b"))


def paths_from(triples: DataFrame, path: str | tuple, starts: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Pairs (a, b) of a property path from the given ``starts`` (a): as ``step``'s with those beginnings, but only what they reach is looked at.
    A start reaches itself by star and opt, whether or not the graph has it; repeated starts count once."""
    return _follow(triples, path, starts.select("a").distinct().select("a", F.col("a").alias("b")), max_rounds)


def paths_to(triples: DataFrame, path: str | tuple, ends: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Pairs (a, b) of a property path to the given ``ends`` (b), searched from them backwards."""
    return paths_from(triples, _reversed(path), ends.select(F.col("b").alias("a")), max_rounds).select(F.col("b").alias("a"), F.col("a").alias("b"))


def closure(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """The transitive closure of (a, b) as a set; new pairs meet all pairs on both sides, so rounds grow with the logarithm of the diameter."""
    known = fresh = staged(edges.distinct())
    for _ in range(max_rounds):
        meet = hub_join if known.count() > MANY else lambda x, y, on: x.join(y, on)
        ahead = meet(fresh.select("a", F.col("b").alias("m")), known.select(F.col("a").alias("m"), "b"), ["m"]).select("a", "b")
        behind = meet(known.select("a", F.col("b").alias("m")), fresh.select(F.col("a").alias("m"), "b"), ["m"]).select("a", "b")
        fresh = staged(ahead.unionByName(behind).distinct().join(known, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            return known
        known = staged(known.unionByName(fresh))
    raise RuntimeError(f"the closure did not settle in {max_rounds} rounds")
