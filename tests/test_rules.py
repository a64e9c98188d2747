"""Rules against a plain-Python fixpoint, the worked example, incremental runs, explanations."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from loomgraph import vocab as V
from loomgraph.operators import rules
from loomgraph.sources.lift import name as n, rdf_list, triples


def plain(given, use, lists):
    """A naive fixpoint of the same rules."""
    known = set(given)
    while True:
        facts = known | {(h, "<item>", i) for h, items in lists.items() for i in items}
        new = set()
        for rule in use:
            bindings = [{}]
            for pattern in rule.body:
                nxt = []
                for b, fact in product(bindings, facts):
                    c = dict(b)
                    if all((c.setdefault(v, x) == x) if v.startswith("?") else v == x for v, x in zip(pattern, fact, strict=True)):
                        nxt.append(c)
                bindings = nxt
            new |= {tuple(b.get(x, x) for x in rule.head) for b in bindings}
        if new <= known:
            return known
        known |= new


def got(df):
    return {(r["s"], r["p"], r["o"]) for r in df.collect()}


EXAMPLE = [
    (n("a1"), n("heldBy"), n("kim")), (n("heldBy"), V.SUBPROPERTY, n("by")), (n("by"), V.DOMAIN, n("Act")), (n("by"), V.RANGE, n("Agent")), (n("Act"), V.SUBCLASS, n("Event")), (n("Event"), V.SUBCLASS, n("Temporal")),
    (n("by"), V.INVERSE, n("did")), (n("Agent"), V.EQUIVALENT, n("Actor")), (n("kim"), V.SAME, n("kim2")), (n("early"), V.TYPE, V.TRANSITIVE), (n("a1"), n("early"), n("a2")), (n("a2"), n("early"), n("a3")), (n("a3"), n("early"), n("a1")),
    (n("Doer"), V.SOME_VALUES, n("Temporal")), (n("Doer"), V.ON_PROPERTY, n("did")), (n("Any"), V.UNION, "_:u"), *rdf_list("_:u", [n("Actor"), n("Event")]), (n("Both"), V.INTERSECTION, "_:i"), *rdf_list("_:i", [n("Actor"), n("Doer")]),
]


@pytest.fixture(scope="module")
def reasoned(spark):
    return rules.infer(triples(spark, EXAMPLE)).cache()


def test_fixpoint_is_the_naive_one(spark, reasoned):
    found = {"_:u": [n("Actor"), n("Event")], "_:i": [n("Actor"), n("Doer")]}
    extra = [rules.Rule("cls-int1", "expressions", (("?x", V.TYPE, n("Actor")), ("?x", V.TYPE, n("Doer"))), ("?x", V.TYPE, n("Both")))]
    assert got(reasoned) == plain(EXAMPLE, rules.RULES + extra, found)


def test_incremental_equals_full_whatever_comes_last(spark, reasoned):
    late = {4, 5, 8, 9}  # subclass axioms, sameness and a transitive typing after the data
    first = rules.infer(triples(spark, [t for i, t in enumerate(EXAMPLE) if i not in late]))
    assert got(rules.infer(triples(spark, [EXAMPLE[i] for i in late]), start=first)) == got(reasoned)


def sample(spark):
    work, employ, colleague, number, age = (n(x) for x in ("worksAt", "employs", "colleague", "number", "age"))
    lit = lambda x: f'"{x}"'
    integer = lambda x: f'"{x}"^^<{V.XSD}integer>'
    rows = [
        *[(n(c), V.TYPE, V.CLASS) for c in ("Worker", "Patriot", "PatriotWorker")], (n("PatriotWorker"), V.INTERSECTION, "_:i"), *rdf_list("_:i", [n("Worker"), n("Patriot")]), (n("Worker"), V.KEY, "_:k"), *rdf_list("_:k", [number]),
        *[(p, V.TYPE, V.OBJECT_PROPERTY) for p in (work, employ, colleague)], (work, V.INVERSE, employ), (colleague, V.CHAIN, "_:c"), *rdf_list("_:c", [work, employ]), (number, V.TYPE, V.DATA_PROPERTY), (age, V.TYPE, V.DATA_PROPERTY),
        (n("kim"), V.TYPE, n("Worker")), (n("kim"), V.TYPE, n("Patriot")), (n("kim"), work, n("co")), (n("kim"), number, lit("7@x")), (n("kim"), age, integer("25")), (n("kim"), V.LABEL, lit("K")),
        (n("rick"), V.TYPE, n("Worker")), (n("rick"), number, lit("7@x")), (n("rick"), age, integer("025")), (n("rick"), V.LABEL, lit("R")),
        (n("lee"), V.TYPE, n("Worker")), (n("lee"), number, lit("8")), (n("co"), employ, n("lee")),
    ]
    return rows, triples(spark, rows)


def test_key_chain_inverse_intersection_example(spark):
    rows, graph = sample(spark)
    out = got(rules.infer(graph)) - set(rows)
    same = {(n(a), V.SAME, n(b)) for a in ("kim", "rick") for b in ("kim", "rick")}
    colleagues = {(n(a), n("colleague"), n(b)) for a in ("kim", "rick", "lee") for b in ("kim", "rick", "lee")}
    assert same | colleagues <= out
    assert (n("rick"), V.TYPE, n("PatriotWorker")) in out and (n("rick"), n("age"), f'"25"^^<{V.XSD}integer>') in out
    assert len(out) == 24


def test_list_axioms_that_arrive_last_hold_for_old_data(spark):
    rows, graph = sample(spark)
    full = got(rules.infer(graph))
    for late in ([V.INTERSECTION, V.CHAIN], [V.FIRST, V.REST]):
        first = rules.infer(triples(spark, [t for t in rows if t[1] not in late]))
        assert got(rules.infer(triples(spark, [t for t in rows if t[1] in late]), start=first)) == full


def test_every_derived_triple_is_explained_down_to_given_ones(spark, reasoned):
    why = {(r["s"], r["p"], r["o"]): r for r in rules.explain(reasoned, reasoned.filter("level > 0")).collect()}
    level = {(r["s"], r["p"], r["o"]): r["level"] for r in reasoned.collect()}
    for t, r in why.items():
        assert r["rule"] != "not entailed"
        if r["rule"] not in ("given", "prp-key"):
            assert all(level[tuple(p)] < level[t] and tuple(p) in why for p in r["premises"])
    assert {t for t, lv in level.items() if lv} <= set(why)
    assert {r["rule"] for r in rules.explain(reasoned, triples(spark, [(n("x"), n("y"), n("z"))])).collect()} == {"not entailed"}


def test_conflicts(spark):
    rows = [(n("A"), V.DISJOINT, n("B")), (n("x"), V.TYPE, n("A")), (n("x"), V.TYPE, n("B")), (n("p"), V.TYPE, V.IRREFLEXIVE), (n("y"), n("p"), n("y")), (n("q"), V.TYPE, V.ASYMMETRIC), (n("a"), n("q"), n("b")), (n("b"), n("q"), n("a")), (n("u"), V.SAME, n("v")), (n("u"), V.DIFFERENT, n("v")), (n("z"), V.TYPE, V.NOTHING)]
    assert {r["rule"] for r in rules.conflicts(triples(spark, rows)).collect()} == {"cls-dj", "prp-irp", "prp-asyp", "eq-diff1", "cls-nothing2"}
    assert rules.conflicts(triples(spark, EXAMPLE)).isEmpty()


def test_lists_with_cycles_and_empty_graphs(spark):
    assert rules.lists(triples(spark, [("_:a", V.FIRST, n("x")), ("_:a", V.REST, "_:b"), ("_:b", V.FIRST, n("y")), ("_:b", V.REST, "_:a")]))["_:a"] == [n("x"), n("y")]
    assert rules.infer(triples(spark, EXAMPLE).limit(0)).isEmpty()


def test_rounds_beyond_the_bound_raise(spark):
    chain = [(n("p"), V.TYPE, V.TRANSITIVE), *[(n(f"c{i}"), n("p"), n(f"c{i + 1}")) for i in range(12)]]
    with pytest.raises(RuntimeError):
        rules.infer(triples(spark, chain), max_rounds=2)
    assert rules.infer(triples(spark, chain)).filter(F.col("p") == n("p")).count() == 78


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_many_triples_are_not_broadcast(spark):
    """Files of triples are a fiftieth of their rows in memory, so their size says nothing of what a broadcast takes."""
    from loomgraph.plans.shared import staged

    graph = staged(spark.createDataFrame([(f"<q{i}>", V.SUBPROPERTY, f"<q{i // 2}>") for i in range(1, 40)], "s string, p string, o string"))
    rule = next(r for r in rules.RULES if r.name == "scm-spo")
    few, many = (rules.apply_rule(rule, graph, total=n) for n in (100, rules.HUB_TRIPLES - 1))
    assert broadcasts(few) and not broadcasts(many)
    assert sorted(few.collect()) == sorted(many.collect())


def test_explanations_of_many_triples(spark, monkeypatch):
    from loomgraph.plans import shared

    rows = [(f"<x{i}>", V.TYPE, "<A>") for i in range(20)] + [("<A>", V.SUBCLASS, "<B>"), ("<B>", V.SUBCLASS, "<C>")]
    reasoned = rules.infer(spark.createDataFrame(rows, "s string, p string, o string"))
    want = sorted(map(str, rules.depth(rules.explain(reasoned, reasoned)).collect()))
    monkeypatch.setattr(shared, "MERGED_ROWS", 0)
    explained = rules.explain(reasoned, reasoned)
    assert sorted(map(str, rules.depth(explained).collect())) == want
    assert not broadcasts(explained)


def test_what_fresh_triples_derive_together_is_made_once(spark):
    """Nor is anything made from a term's sameness with itself, nor is a rule asked for it."""
    rule = next(r for r in rules.RULES if r.name == "eq-rep-s")
    old = [("<c>", V.SAME, "<a>"), ("<c>", "<p>", "<o>")]
    fresh = [("<a>", V.SAME, "<c>"), ("<a>", "<p>", "<o>"), ("<a>", V.SAME, "<a>")]
    made = rules.apply_rule(rule, triples(spark, old + fresh), triples(spark, fresh), old=triples(spark, old))
    assert sorted(tuple(r) for r in made.collect()) == [("<c>", V.SAME, "<a>"), ("<c>", V.SAME, "<c>"), ("<c>", "<p>", "<o>")]
    said = rules._profile(triples(spark, fresh)), rules._profile(triples(spark, fresh[1:]))
    assert [x.same for x in said] == [True, False] and V.SAME in said[1].predicates
    given = [(V.SAME, V.SAME, "<q>"), ("<c>", V.SAME, "<a>"), ("<c>", V.SAME, "<c>"), ("<a>", "<p>", "<o>")]
    equality = {"eq-sym", "eq-rep-s", "eq-rep-p"}
    want = plain(given, [r for r in rules.RULES if r.name in equality], {})
    assert got(rules.infer(triples(spark, given), only=equality)) == want
    first = rules.infer(triples(spark, given[:2]), only=equality)
    assert got(rules.infer(triples(spark, given[2:]), start=first, only=equality)) == want


def test_rules_that_hand_on_the_predicate_of_a_fresh_triple():
    rule = {r.name: r for r in rules.RULES}
    assert rules._hands_on(rule["eq-rep-s"], {n("p")}) and not rules._hands_on(rule["eq-rep-s"], {V.SAME}) and not rules._hands_on(rule["eq-rep-s"], None)
    assert rules._hands_on(rule["prp-trp"], set()) and not rules._hands_on(rule["prp-trp"], {V.TYPE})
    assert not any(rules._hands_on(rule[k], set()) for k in ("eq-rep-p", "prp-spo1", "prp-inv"))
