"""Entailment rules as graph patterns, and their fixpoint by semi-naive rounds.

A rule is a body of patterns and a head. A round joins each body once for every pattern, that pattern over the newest
triples and the others over all; all rules go in one job. Axioms over lists (chains, intersections, keys) become rules
of their own when the run begins. The result is the least fixpoint, whatever the order in which triples arrived.

The patterns of a body that speak of the schema (subclasses, domains, restrictions, ...) are solved first, on the driver, as
long as the schema has at most MAX_SCHEMA triples and they have at most MAX_SOLUTIONS solutions. Their solutions are broadcast, and their terms
filter the scans of the data, which lie in folders by predicate (``plans.layout``); so data are never dealt by a class or a predicate. A larger schema is joined as data are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import vocab as V
from loomgraph.operators.changes import replay
from loomgraph.operators.patterns import Pattern, join, scan
from loomgraph.plans.layout import GROUP, Layout, group_of, small_tasks, with_predicates
from loomgraph.plans.shared import attach, cut, merged, stage, staged


@dataclass(frozen=True)
class Rule:
    name: str
    group: str
    body: tuple[Pattern, ...]
    head: Pattern


def _rule(name: str, group: str, *patterns: str) -> Rule:
    parts = [tuple(p.split()) for p in patterns]
    return Rule(name, group, tuple(parts[:-1]), parts[-1])


T = V.TYPE
#: Triples of the schema that the driver may hold and broadcast; terms that may filter a scan.
MAX_SCHEMA, MAX_TERMS = 100_000, 500
#: Solutions of a rule's schema patterns that the driver may make and broadcast.
MAX_SOLUTIONS = 200_000
#: From so many triples on, joins of data split the keys that many rows have.
HUB_TRIPLES = 2_000_000
#: In the order in which an explanation prefers them.
RULES = [
    _rule("cax-sco", "core", f"?x {T} ?c", f"?c {V.SUBCLASS} ?d", f"?x {T} ?d"),
    _rule("cax-eqc", "core", f"?x {T} ?c", f"?c {V.EQUIVALENT} ?d", f"?x {T} ?d"),
    _rule("cax-eqc", "core", f"?x {T} ?d", f"?c {V.EQUIVALENT} ?d", f"?x {T} ?c"),
    _rule("prp-dom", "core", "?x ?p ?y", f"?p {V.DOMAIN} ?c", f"?x {T} ?c"),
    _rule("prp-rng", "core", "?x ?p ?y", f"?p {V.RANGE} ?c", f"?y {T} ?c"),
    _rule("cls-uni", "expressions", f"?c {V.UNION} ?l", "?l <item> ?d", f"?x {T} ?d", f"?x {T} ?c"),
    _rule("cls-int2", "expressions", f"?c {V.INTERSECTION} ?l", "?l <item> ?d", f"?x {T} ?c", f"?x {T} ?d"),
    _rule("cls-svf1", "restrictions", f"?r {V.SOME_VALUES} ?y", f"?r {V.ON_PROPERTY} ?p", "?u ?p ?v", f"?v {T} ?y", f"?u {T} ?r"),
    _rule("cls-avf", "restrictions", f"?r {V.ALL_VALUES} ?y", f"?r {V.ON_PROPERTY} ?p", f"?u {T} ?r", "?u ?p ?v", f"?v {T} ?y"),
    _rule("scm-sco", "schema", f"?c {V.SUBCLASS} ?d", f"?d {V.SUBCLASS} ?e", f"?c {V.SUBCLASS} ?e"),
    _rule("scm-spo", "schema", f"?p {V.SUBPROPERTY} ?q", f"?q {V.SUBPROPERTY} ?r", f"?p {V.SUBPROPERTY} ?r"),
    _rule("eq-sym", "equality", f"?x {V.SAME} ?y", f"?y {V.SAME} ?x"),
    _rule("eq-trans", "equality", f"?x {V.SAME} ?y", f"?y {V.SAME} ?z", f"?x {V.SAME} ?z"),
    _rule("prp-spo1", "core", "?x ?p ?y", f"?p {V.SUBPROPERTY} ?q", "?x ?q ?y"),
    _rule("prp-inv", "core", "?x ?p ?y", f"?p {V.INVERSE} ?q", "?y ?q ?x"),
    _rule("prp-inv", "core", "?x ?q ?y", f"?p {V.INVERSE} ?q", "?y ?p ?x"),
    _rule("prp-trp", "core", f"?p {T} {V.TRANSITIVE}", "?x ?p ?y", "?y ?p ?z", "?x ?p ?z"),
    _rule("eq-rep-s", "equality", f"?s {V.SAME} ?t", "?s ?p ?o", "?t ?p ?o"),
    _rule("eq-rep-p", "equality", f"?p {V.SAME} ?q", "?s ?p ?o", "?s ?q ?o"),
    _rule("eq-rep-o", "equality", f"?o {V.SAME} ?q", "?s ?p ?o", "?s ?p ?q"),
]
#: What each rule says, for people.
TEXT = {
    "cax-sco": "a member of a class is one of its superclasses", "cax-eqc": "equivalent classes have the same members", "prp-dom": "the subject of a property is in its domain", "prp-rng": "the object of a property is in its range",
    "cls-uni": "a member of a part is in the union", "cls-int1": "a member of all parts is in the intersection", "cls-int2": "a member of the intersection is in each part", "cls-svf1": "a value in the class meets 'some'", "cls-avf": "'only' holds for every value",
    "scm-sco": "subclasses are transitive", "scm-spo": "subproperties are transitive", "eq-sym": "sameness is symmetric", "eq-trans": "sameness is transitive", "prp-key": "equal keys mean the same individual", "prp-spo1": "a subproperty implies its superproperty",
    "prp-inv": "inverse properties hold the other way round", "prp-trp": "the property is transitive", "prp-spo2": "a chain of properties implies the property", "eq-rep-s": "same subject", "eq-rep-p": "same property", "eq-rep-o": "same object",
}
CHECKS = [
    _rule("cls-dj", "schema", f"?c {V.DISJOINT} ?d", f"?x {T} ?c", f"?x {T} ?d", f"?x {T} {V.NOTHING}"),
    _rule("prp-irp", "restrictions", f"?p {T} {V.IRREFLEXIVE}", "?x ?p ?x", f"?x {T} {V.NOTHING}"),
    _rule("prp-asyp", "restrictions", f"?p {T} {V.ASYMMETRIC}", "?x ?p ?y", "?y ?p ?x", f"?x {T} {V.NOTHING}"),
    _rule("eq-diff1", "equality", f"?x {V.SAME} ?y", f"?x {V.DIFFERENT} ?y", f"?x {T} {V.NOTHING}"),
    _rule("cls-nothing2", "schema", f"?x {T} {V.NOTHING}", f"?x {T} {V.NOTHING}"),
]
GROUPS = ("core", "equality", "chains", "expressions", "restrictions", "schema")
#: Axioms over lists are schema: they are read to the driver. More than this many list cells are refused.
MAX_CELLS = 1_000_000


def lists(triples: DataFrame) -> dict[str, list[str]]:
    """RDF lists by head. A cell with several values counts with the smallest; cycles end where they close."""
    narrow = with_predicates(triples, [V.FIRST, V.REST]).filter(F.col("p").isin(V.FIRST, V.REST))
    rows = narrow.groupBy("s").agg(F.min(F.when(F.col("p") == V.FIRST, F.col("o"))).alias("item"), F.min(F.when(F.col("p") == V.REST, F.col("o"))).alias("rest")).limit(MAX_CELLS + 1).collect()
    if len(rows) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} list cells")
    cells = {r["s"]: (r["item"], r["rest"]) for r in rows}
    out = {}
    for head in cells:
        items, at, seen = [], head, set()
        while at in cells and at not in seen and cells[at][0] is not None:
            seen.add(at)
            items.append(cells[at][0])
            at = cells[at][1]
        out[head] = items
    return out


#: Terms without which the rules that name them are idle.
_SCHEMA = {V.SUBCLASS, V.SUBPROPERTY, V.DOMAIN, V.RANGE, V.EQUIVALENT, V.UNION, V.INTERSECTION, V.SOME_VALUES, V.ALL_VALUES, V.ON_PROPERTY, V.INVERSE, V.SAME, V.TRANSITIVE}


def list_rules(triples: DataFrame, found: dict[str, list[str]]) -> tuple[list[Rule], list[tuple[str, list[str]]]]:
    """Rules for property chains and intersections, and the keys (class, properties)."""
    axioms = with_predicates(triples, [V.CHAIN, V.INTERSECTION, V.KEY]).filter(F.col("p").isin(V.CHAIN, V.INTERSECTION, V.KEY)).select("s", "p", "o").distinct().collect() if found else []
    rules, keys = [], []
    for s, p, o in sorted((r["s"], r["p"], r["o"]) for r in axioms):
        items = list(dict.fromkeys(found.get(o, []))) if p == V.INTERSECTION else found.get(o, [])
        if items and p == V.CHAIN:
            rules.append(Rule("prp-spo2", "chains", tuple((f"?x{i}", q, f"?x{i + 1}") for i, q in enumerate(items)), ("?x0", s, f"?x{len(items)}")))
        elif items and p == V.INTERSECTION:
            rules.append(Rule("cls-int1", "expressions", tuple(("?x", T, c) for c in items), ("?x", T, s)))
        elif items:
            keys.append((s, items))
    return rules, keys


def same_by_key(triples: DataFrame, cls: str, keys: list[str], total: int = 0) -> DataFrame:
    """sameAs triples for members of a class with equal sets of values for every key property; each from the group's smallest
    member, which eq-sym and eq-trans complete. ``total``: how many triples there are."""
    members = scan(triples, ("?x", T, cls)).distinct()
    for i, k in enumerate(keys):
        held = with_predicates(triples, [k]).filter(F.col("p") == k).groupBy(F.col("s").alias("x")).agg(F.array_sort(F.collect_set("o")).alias(f"k{i}"))
        members = members.join(merged(held, total), "x")
    names = [f"k{i}" for i in range(len(keys))]
    keyed = staged(members.select("x", F.struct(*names).alias("key")))
    first = staged(keyed.groupBy("key").agg(F.min("x").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    return attach(keyed, first, "key", "n", "x").filter("x <> first").select(F.col("first").alias("s"), F.lit(V.SAME).alias("p"), F.col("x").alias("o"))


#: Predicates of schema patterns; (property, type, transitive) is one as well.
_SCHEMA_PREDICATES = {V.SUBCLASS, V.SUBPROPERTY, V.DOMAIN, V.RANGE, V.EQUIVALENT, V.UNION, V.INTERSECTION, V.SOME_VALUES, V.ALL_VALUES, V.ON_PROPERTY, V.INVERSE, "<item>"}
_SCHEMA_TYPES = {V.TRANSITIVE, V.IRREFLEXIVE, V.ASYMMETRIC}
Triple = tuple[str, str, str]


def _of_schema(pattern: Pattern) -> bool:
    return pattern[1] in _SCHEMA_PREDICATES | {V.DISJOINT} or pattern[1] == T and pattern[2] in _SCHEMA_TYPES


def schema_rows(triples: DataFrame) -> list[Triple] | None:
    """The triples that schema patterns can meet, or None if they are more than MAX_SCHEMA."""
    named = sorted(_SCHEMA_PREDICATES | {V.DISJOINT})
    wanted = F.col("p").isin(named) | (F.col("p") == T) & F.col("o").isin(sorted(_SCHEMA_TYPES))
    rows = with_predicates(triples, [*named, T]).filter(wanted).select("s", "p", "o").limit(MAX_SCHEMA + 1).collect()
    return [tuple(r) for r in rows] if len(rows) <= MAX_SCHEMA else None


class _TooMany(Exception):
    """The schema patterns have more solutions than the driver may make."""


def _solutions(patterns: list[Pattern], sources: list[list[Triple]]) -> list[dict[str, str]]:
    """The solutions of schema patterns, each over its own triples; _TooMany beyond MAX_SOLUTIONS, as soon as they are made."""
    found: list[dict[str, str]] = [{}]
    for pattern, source in zip(patterns, sources, strict=True):
        known = [i for i, x in enumerate(pattern) if not x.startswith("?") or found and x in found[0]]
        index: dict[tuple, list[Triple]] = {}
        for t in source:
            index.setdefault(tuple(t[i] for i in known), []).append(t)
        more = []
        for b in found:
            for t in index.get(tuple(b.get(pattern[i], pattern[i]) for i in known), []):
                new = dict(b)
                if all(not x.startswith("?") or new.setdefault(x, v) == v for x, v in zip(pattern, t, strict=True)):
                    more.append(new)
            if len(more) > MAX_SOLUTIONS:
                raise _TooMany
        found = more
    return [dict(x) for x in {tuple(sorted(b.items())): None for b in found}]


def _bound(sources: list[DataFrame], body: tuple[Pattern, ...], small: list[list[Triple]] | None = None, total: int = 0) -> DataFrame | None:
    """The body's solutions, with the i-th pattern over the i-th source. ``small``: for each schema pattern the triples to take instead; None if
    they have no solution. ``total``: how many triples there are; joins of many data are merged, and split keys that many rows have."""
    rest, out = list(zip(body, sources, strict=True)), None
    first = [k for k, p in enumerate(body) if small is not None and _of_schema(p)]
    solved = None
    if first and len(first) < len(body):
        try:
            solved = _solutions([body[k] for k in first], [small[k] for k in first])
        except _TooMany:
            first = []
    if solved is not None:
        if not solved:
            return None
        rest = [x for k, x in enumerate(rest) if k not in first]
        terms = {v: sorted({b[v] for b in solved}) for v in solved[0]}
        if terms:  # of many schema solutions each data row meets few, so the data are the side that stays
            few = rest[0][1].sparkSession.createDataFrame([tuple(b[v] for v in terms) for b in solved], ", ".join(f"`{v[1:]}` string" for v in terms))
            out = F.broadcast(few)

        def narrowed(pattern: Pattern, source: DataFrame) -> DataFrame:
            for c, x in zip("spo", pattern, strict=True):
                if x in terms and len(terms[x]) <= MAX_TERMS:
                    source = (with_predicates(source, terms[x]) if c == "p" else source).filter(F.col(c).isin(terms[x]))
            return source

        rest = [(p, narrowed(p, s)) for p, s in rest]
    wide = out is None  # whether ``out`` has rows of the data
    if out is None:
        pattern, source = rest.pop(0)
        out = scan(source, pattern)
    while rest:
        k = next((i for i, (p, _) in enumerate(rest) if {v[1:] for v in p if v.startswith("?")} & set(out.columns)), None)
        if k is None:
            raise ValueError(f"the patterns of {body} hang apart")
        pattern, source = rest.pop(k)
        out = join(out, merged(scan(source, pattern), total), total >= HUB_TRIPLES) if wide else join(scan(source, pattern), out)
        wide = True
    return out


def _headed(solutions: DataFrame, head: Pattern) -> DataFrame:
    return solutions.select(*[(F.col(x[1:]) if x.startswith("?") else F.lit(x)).alias(c) for c, x in zip("spo", head, strict=True)])


def apply_rule(rule: Rule, triples: DataFrame, fresh: DataFrame | None = None, news: set[str] | None = None, schema: list[Triple] | None = None, fresh_schema: list[Triple] | None = None, total: int = 0, old: DataFrame | None = None) -> DataFrame | None:
    """What a rule derives; with ``fresh``, only what needs at least one fresh triple (None if nothing can). ``news``: those of the
    predicates that bodies name which fresh triples have; a pattern of another predicate meets no fresh triple. ``schema``, ``fresh_schema``:
    the schema's triples where the driver holds them. ``total``: how many triples there are. ``old``: the triples without the fresh ones, so that what
    several fresh triples derive together is made once. That a term is the same as itself tells the rules of equality nothing, and is left out."""
    n = len(rule.body)

    def moved(source: DataFrame, k: int) -> DataFrame:
        return source.filter("s <> o") if rule.group == "equality" and rule.body[k][1] == V.SAME else source

    if fresh is None:
        found = _bound([moved(triples, k) for k in range(n)], rule.body, None if schema is None else [schema] * n, total)
        return None if found is None else _headed(found, rule.head)
    met = [k for k, (_, p, _) in enumerate(rule.body) if p.startswith("?") or news is None or p in news]
    before = triples if old is None else old
    parts = [_bound([moved(before if i < k else fresh if i == k else triples, i) for i in range(n)], rule.body, None if schema is None else [fresh_schema if i == k else schema for i in range(n)], total) for k in met]
    parts = [_headed(x, rule.head) for x in parts if x is not None]
    return reduce(DataFrame.unionByName, parts) if parts else None


_LISTS, _AXIOMS = {V.FIRST, V.REST}, {V.CHAIN, V.INTERSECTION, V.KEY}


@dataclass(frozen=True)
class _Profile:
    """What one pass over triples tells: how many they are, which of some terms they have at which place, whether any is of the schema, whether any says that two terms are the same,
    and in which folders they lie."""

    n: int
    subjects: set[str]
    predicates: set[str]
    objects: set[str]
    schema: bool
    same: bool
    groups: set[int]


def _profile(triples: DataFrame, more: list[str] = ()) -> _Profile:
    terms = sorted(_SCHEMA | _SCHEMA_TYPES | _SCHEMA_PREDICATES | {V.DISJOINT} | _LISTS | _AXIOMS)
    held = [F.collect_set(F.when(F.col(c).isin([*terms, *(more if c == "p" else [])]), F.col(c))).alias(c) for c in "spo"]
    of_schema = F.col("p").isin(sorted(_SCHEMA_PREDICATES | {V.DISJOINT})) | (F.col("p") == T) & F.col("o").isin(sorted(_SCHEMA_TYPES))
    row = triples.agg(F.count("*").alias("n"), *held, F.max(of_schema).alias("schema"), F.max((F.col("p") == V.SAME) & (F.col("s") != F.col("o"))).alias("same"), F.collect_set(GROUP if GROUP in triples.columns else F.lit(None).cast("int")).alias("groups")).collect()[0]
    return _Profile(row["n"], set(row["s"]), set(row["p"]), set(row["o"]), bool(row["schema"]), bool(row["same"]), set(row["groups"]))


def _active(found: _Profile, rules: list[Rule], keys: bool) -> list[Rule]:
    """The rules that can ever fire: a schema term that a body names must be in the graph, unless the graph says something about schema terms themselves."""
    said = (found.subjects | found.objects) & _SCHEMA
    if said - {V.TRANSITIVE}:
        return rules
    seen = said | found.predicates | ({V.SAME} if keys else set())
    return [r for r in rules if all(x in seen for _, p, o in r.body for x in (p, o) if x in _SCHEMA)]


def eq_ref(triples: DataFrame) -> DataFrame:
    """x sameAs x for every term of the graph. No run derives these: they are as many as the terms, and no other rule needs them."""
    return triples.select(F.explode(F.array("s", "p", "o")).alias("s")).distinct().select("s", F.lit(V.SAME).alias("p"), F.col("s").alias("o"))


def _hands_on(rule: Rule, news: set[str] | None) -> bool:
    """Whether all that the rule derives has the predicate of a fresh triple."""
    return all(p == rule.head[1] for _, p, _ in rule.body if p.startswith("?") or news is None or p in news)


def infer(given: DataFrame, groups: tuple[str, ...] = GROUPS, only: set[str] | None = None, start: DataFrame | None = None, max_rounds: int = 50) -> DataFrame:
    """(s, p, o, level, rule): the given triples at level 0 and all that follow, at the round that derived them first, by the
    first rule in the order of RULES.

    ``start``: an earlier result that ``given`` is added to; only what needs an added triple is looked for, and
    all that a chain or an intersection entails which was added or changed (for additions; after removals infer again from the start). ``only``: names of the rules to use. Runs beyond
    ``max_rounds`` raise. Literals may come out as subjects.
    """
    spark = given.sparkSession
    files = Layout.new(spark)
    read = files.read
    with small_tasks(spark):  # dealt first: tasks that read the tables hold no triples, however many rows they take
        zero = given.select("s", "p", "o").dropna().repartition("s", "p", "o").distinct().select("s", "p", "o", F.lit(0).alias("level"), F.lit(None).cast("string").alias("rule"))
        if start is not None:
            zero = zero.join(start, ["s", "p", "o"], "left_anti")
        # every round's triples are one more folder of a single scan
        paths, full = [files.add(zero)], "s string, p string, o string, level int, rule string"
    if start is not None:
        paths.insert(0, files.add(start.select("s", "p", "o", "level", "rule")))
    plain = read(paths)
    profile = _profile(plain)
    total = profile.n
    found = lists(plain) if profile.predicates & _LISTS else {}
    extra, keys = list_rules(plain, found) if profile.predicates & _AXIOMS else ([], [])
    use = [r for r in RULES + extra if r.group in groups and (only is None or r.name in only)]
    if not ("restrictions" in groups and (only is None or "prp-key" in only)):
        keys = []
    use = _active(profile, use, bool(keys))
    # the bodies of these hold data patterns only, which an axiom that is added does not meet: once, they go over all triples
    late = set()
    if start is not None and extra:
        before = read(paths[:1])
        late = set(extra) - set(list_rules(before, lists(before))[0])
    cells = [(h, "<item>", i) for h, items in found.items() for i in dict.fromkeys(items)]
    extra_paths = [files.add(spark.createDataFrame(cells, "s string, p string, o string"), many=False)] if cells else []
    order = list(dict.fromkeys([*(r.name for r in RULES), *(r.name for r in use), "prp-key"]))
    named = sorted({p for r in use for _, p, _ in r.body if not p.startswith("?")} | {T for _ in keys} | {k for _, ks in keys for k in ks})
    schema = schema_rows(plain) if profile.schema else []
    if schema is not None:
        schema = schema + cells if len(schema) + len(cells) <= MAX_SCHEMA else None
    fresh, fresh_schema, old = (None, None, None) if start is None else (read([paths[1], *extra_paths]), None, read(paths[:1]))
    for level in range(1, max_rounds + 1):
        everything = read(paths + extra_paths)
        news = None
        if fresh is not None:
            profile = _profile(fresh, named)
            if not profile.n:
                return files.read(paths, full).drop(GROUP)
            total += profile.n if level > 1 else 0
            news = profile.predicates & set(named)
        if fresh is not None and schema is not None:
            fresh_schema = schema_rows(fresh.filter(F.col("p") != "<item>")) if profile.schema else []
            if fresh_schema is not None and level == 1:
                fresh_schema = fresh_schema + cells
            schema = None if fresh_schema is None else list(dict.fromkeys(schema + fresh_schema))
            schema = None if schema is None or len(schema) > MAX_SCHEMA else schema
        met = {r: news - {V.SAME} if news and r.group == "equality" and not profile.same else news for r in use}
        fired = [(r.name, r.head, d) for r in use if (d := apply_rule(r, everything, None if level == 1 and r in late else fresh, met[r], schema, fresh_schema, total, old)) is not None]
        fired += [("prp-key", ("?x", V.SAME, "?y"), same_by_key(everything, c, k, total)) for c, k in keys if news is None or news & {T, *k}]
        if not fired:
            return files.read(paths, full).drop(GROUP)
        derived = reduce(DataFrame.unionByName, [d.withColumn("rank", F.lit(order.index(name))) for name, _, d in fired])
        heads = {h[1] for _, h, _ in fired}
        # only what has a head's predicate can be there already, or one of a fresh triple if the head's is that of the only pattern that meets fresh ones
        there = everything if any(p.startswith("?") for p in heads) else with_predicates(everything, sorted(heads)).filter(F.col("p").isin(sorted(heads)))
        if fresh is not None and any(p.startswith("?") for p in heads) and not (level == 1 and late) and all(_hands_on(r, met[r]) for r in use if r.head[1].startswith("?")):
            fixed = [group_of(F.lit(p)) for p in sorted(heads) if not p.startswith("?")]
            there = everything.filter(F.col(GROUP).isin([*sorted(profile.groups), *fixed]))
        new = derived.groupBy("s", "p", "o").agg(F.min("rank").alias("rank")).join(merged(there.select("s", "p", "o"), total), ["s", "p", "o"], "left_anti")
        path = files.add(new.select("s", "p", "o", F.lit(level).alias("level"), F.element_at(F.array(*map(F.lit, order)), F.col("rank") + 1).alias("rule")), many=total >= HUB_TRIPLES)
        fresh, old = read([path]), everything
        paths.append(path)
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")


def consistent(triples: DataFrame, groups: tuple[str, ...] = GROUPS) -> bool:
    return conflicts(triples, groups).isEmpty()


def update(asserted: DataFrame, reasoned: DataFrame | None, log: DataFrame, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """The result of reasoning after the changes ``log`` (batch, seq, op, s, p, o) to ``asserted``: a full run if anything is removed, if
    there is no result yet or if it is inconsistent; else only what the additions entail is added."""
    after = replay(asserted, log)
    if reasoned is None or not log.filter("op = 'remove'").isEmpty() or not consistent(reasoned, groups):
        return infer(after, groups)
    return infer(log.filter("op = 'add'").select("s", "p", "o"), groups, start=reasoned)


def conflicts(triples: DataFrame, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """(rule, conflict): every violation with the triples that clash, as an array of (s, p, o); none means consistent."""
    out, plain = [], triples.select("s", "p", "o")
    schema = schema_rows(plain)
    for rule in CHECKS:
        if rule.group in groups:
            solved = _bound([plain] * len(rule.body), rule.body, None if schema is None else [schema] * len(rule.body))
            if solved is None:
                continue
            cell = lambda x: F.col(x[1:]) if x.startswith("?") else F.lit(x)
            clash = F.array(*[F.struct(*[cell(x).alias(c) for c, x in zip("spo", p, strict=True)]) for p in rule.body])
            out.append(solved.select(F.lit(rule.name).alias("rule"), clash.alias("conflict")))
    if not out:
        return plain.limit(0).select(F.lit("").alias("rule"), F.array(F.struct("s", "p", "o")).alias("conflict"))
    return reduce(DataFrame.unionByName, out).distinct()


#: What each check's conflict means, for people: its triples' ends by place.
CONFLICT_TEXT = {
    "cls-dj": ("{1.s} is in two disjoint classes, {0.s} and {0.o}"), "prp-irp": "{1.s} has the irreflexive property {0.s} to itself", "prp-asyp": "the asymmetric property {0.s} holds between {1.s} and {1.o} both ways",
    "eq-diff1": "{0.s} and {0.o} are the same and different", "cls-nothing2": "{0.s} is in the empty class",
}


def described(found: DataFrame) -> DataFrame:
    """Conflicts with a column ``text`` that says what clashes."""
    text = F.lit(None).cast("string")
    for rule, form in CONFLICT_TEXT.items():
        parts = re.split(r"\{(\d)\.([spo])\}", form)
        cells = [F.lit(parts[0])]
        for k in range(1, len(parts), 3):
            cells += [F.col("conflict")[int(parts[k])][parts[k + 1]], F.lit(parts[k + 2])]
        text = F.when(F.col("rule") == rule, F.concat(*cells)).otherwise(text)
    return found.withColumn("text", text)


_PREMISES = "array<struct<s: string, p: string, o: string>>"


def _key_ways(derived: DataFrame, plain: DataFrame, keys: list[tuple[str, list[str]]], rank: int) -> list[DataFrame]:
    """Both members' typings and key values, for sameness by key."""
    ways = []
    for cls, names in keys:
        known = plain.filter((F.col("p") == T) & (F.col("o") == cls) | F.col("p").isin(names))
        facts = known.groupBy("s").agg(F.array_sort(F.collect_set(F.struct("s", "p", "o"))).alias("facts"), F.max("level").alias("top"), F.max(F.when(F.col("p") == T, 1)).alias("typed"), F.array_sort(F.collect_set(F.when(F.col("p") != T, F.struct("p", "o")))).alias("key"))
        facts = facts.filter(F.col("typed").isNotNull() & (F.size(F.array_distinct(F.transform("key", lambda k: k["p"]))) == len(set(names))))
        side = lambda n: facts.select(F.col("s").alias(n), F.col("facts").alias(f"f_{n}"), F.col("top").alias(f"t_{n}"), F.col("key").alias(f"k_{n}"))  # noqa: E731,B023
        pair = derived.filter(F.col("p") == V.SAME).join(side("s"), "s").join(side("o"), "o").filter((F.col("k_s") == F.col("k_o")) & (F.greatest("t_s", "t_o") < F.col("level")))
        ways.append(pair.select("s", "p", "o", F.lit(rank).alias("rank"), F.lit("prp-key").alias("rule"), F.concat("f_s", "f_o").cast(_PREMISES).alias("premises"), "level"))
    return ways


def explain(reasoned: DataFrame, targets: DataFrame, max_steps: int = 50, max_facts: int | None = None) -> DataFrame:
    """(s, p, o, rule, premises, level) for the targets (s, p, o) and all they rest on: one derivation of each, from triples of
    lower levels by the first rule in the order of RULES. Given triples have rule "given" (or "imported", where ``reasoned`` has an
    ``origin`` that says so); targets that don't hold come out as "not entailed", derived ones that no rule explains as "unexplained". Sameness by key
    rests on both members' typings and key values. Steps that would begin with more than ``max_facts`` facts, or come after ``max_steps``, are left out: their
    facts come out as "truncated"."""
    with small_tasks(reasoned.sparkSession):
        return _explain(reasoned, targets, max_steps, max_facts)


def _explain(reasoned: DataFrame, targets: DataFrame, max_steps: int, max_facts: int | None) -> DataFrame:
    """All joins are done when this returns, so none is left to larger tasks."""
    imported = F.col("origin") == "imported" if "origin" in reasoned.columns else F.lit(False)
    plain = reasoned.select("s", "p", "o", "level")
    found = lists(plain)
    extra, keys = list_rules(plain.select("s", "p", "o"), found)
    spark = reasoned.sparkSession
    if any(found.values()):
        plain = plain.unionByName(spark.createDataFrame([(h, "<item>", i, 0) for h, items in found.items() for i in dict.fromkeys(items)], "s string, p string, o string, level int"))
    counts = {r["rule"]: r["n"] for r in reasoned.groupBy("rule").agg(F.count("*").alias("n")).collect()}
    used, total = set(counts), sum(counts.values())
    few_schema = schema_rows(plain.select("s", "p", "o")) is not None
    reasoned = merged(reasoned, total)
    rules = [r for r in RULES + extra if r.name in used]
    asked = cut(targets.select("s", "p", "o").distinct())
    ended = lambda df, what: df.select("s", "p", "o", F.lit(what).alias("rule"), F.lit(None).cast(_PREMISES).alias("premises"), F.lit(None).cast("int").alias("level"))
    pieces, frontier = [ended(staged(asked.join(reasoned, ["s", "p", "o"], "left_anti")), "not entailed")], merged(asked, total)
    done, facts = asked.limit(0), 0
    for number in range(max_steps + 1):
        if max_facts is not None:
            facts += frontier.count()
        if number == max_steps or max_facts is not None and facts > max_facts:
            return reduce(DataFrame.unionByName, [*pieces, ended(staged(frontier.join(reasoned, ["s", "p", "o"], "left_semi")), "truncated")])
        known = reasoned.join(frontier, ["s", "p", "o"], "left_semi").select("s", "p", "o", "level", F.coalesce("rule", F.when(imported, "imported").otherwise("given")).alias("via"))
        given = known.filter("level = 0").select("s", "p", "o", F.col("via").alias("rule"), F.lit(None).cast(_PREMISES).alias("premises"), "level")
        derived = cut(known.filter("level > 0").select("s", "p", "o", "level"))
        ways = _key_ways(derived, plain, keys, len(rules)) if "prp-key" in used else []
        for rank, rule in enumerate(rules):
            heads = scan(derived, rule.head, {"level": "_top"})
            solved = heads
            rest = list(rule.body)
            tops = []
            while rest:
                k = next((i for i, p in enumerate(rest) if {v[1:] for v in p if v.startswith("?")} & set(solved.columns)), 0)
                pattern = rest.pop(k)
                tops.append(f"_l{len(tops)}")
                more = scan(plain, pattern, {"level": tops[-1]})
                solved = join(solved, F.broadcast(more) if few_schema and _of_schema(pattern) else merged(more, total))
            solved = solved.filter(reduce(lambda a, b: a & b, [F.col(t) < F.col("_top") for t in tops]))
            cell = lambda x: F.col(x[1:]) if x.startswith("?") else F.lit(x)
            premises = F.array(*[F.struct(*[cell(x).alias(c) for c, x in zip("spo", p, strict=True)]) for p in rule.body if p[1] != "<item>"])
            ways.append(solved.select(*[cell(x).alias(c) for c, x in zip("spo", rule.head, strict=True)], F.lit(rank).alias("rank"), F.lit(rule.name).alias("rule"), premises.alias("premises"), F.col("_top").alias("level")))
        if not ways:
            return reduce(DataFrame.unionByName, [*pieces, given, ended(derived, "unexplained")])
        best = reduce(DataFrame.unionByName, ways).groupBy("s", "p", "o").agg(F.min(F.struct("rank", "premises", "rule", "level")).alias("w")).select("s", "p", "o", "w.rule", "w.premises", "w.level")
        step = staged(given.unionByName(best))
        pieces += [step, ended(staged(derived.join(merged(step, total), ["s", "p", "o"], "left_anti")), "unexplained")]
        done = merged(staged(done.unionByName(step.select("s", "p", "o"))), total)
        frontier = merged(staged(step.select(F.explode("premises").alias("t")).select("t.s", "t.p", "t.o").distinct().join(done, ["s", "p", "o"], "left_anti")), total)
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, pieces)
    raise AssertionError


def justification(explained: DataFrame) -> DataFrame:
    """The given and imported triples that an explanation rests on, in order."""
    return explained.filter("rule in ('given', 'imported')").select("s", "p", "o").distinct().orderBy("s", "p", "o")


def depth(explained: DataFrame, max_steps: int = 50) -> DataFrame:
    """(s, p, o, depth): the longest way of derivations from each explained triple down to given ones, which have depth 0."""
    facts = staged(explained.filter("rule != 'not entailed'").select("s", "p", "o", "premises"))
    total = facts.count()
    uses = merged(facts.select(F.struct("s", "p", "o").alias("f"), F.explode("premises").alias("q")), total)
    deep = staged(facts.select(F.struct("s", "p", "o").alias("f"), F.lit(0).alias("depth")))
    for _ in range(max_steps):
        over = uses.join(deep.select(F.col("f").alias("q"), "depth"), "q").groupBy("f").agg((F.max("depth") + 1).alias("more"))
        now = staged(deep.join(merged(over, total), "f", "left").select("f", F.coalesce("more", "depth").alias("depth"), (F.coalesce("more", "depth") != F.col("depth")).alias("grew")))
        deep = now.select("f", "depth")
        if now.filter("grew").isEmpty():
            return deep.select("f.s", "f.p", "f.o", "depth")
    raise RuntimeError(f"deeper than {max_steps}")


def chain_path(triples: DataFrame, chain: list[str], start: str, end: str) -> DataFrame:
    """(path): the ways along a chain of properties from one individual to another, as the individuals on them."""
    found = triples.filter((F.col("p") == chain[0]) & (F.col("s") == start)).select(F.array("s", "o").alias("path")).distinct()
    for p in chain[1:]:
        step = triples.filter(F.col("p") == p).select(F.col("s").alias("at"), F.col("o").alias("to")).distinct()
        found = found.join(step, F.element_at("path", -1) == F.col("at")).select(F.concat("path", F.array("to")).alias("path"))
    return found.filter(F.element_at("path", -1) == end)
