"""Edits, limits, conflicts and bases on small graphs."""

import os
import time

import pytest
from pyspark.sql import functions as F

from loomgraph import vocab as V
from loomgraph.operators import analytics, changes, editing, patterns as P, rules
from loomgraph.sources import rdf
from loomgraph.sources.lift import triples


def n(x):
    return f"<http://e/{x}>"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_adders_and_batches(spark):
    made = [editing.add_individual(spark, n("i"), n("C")), editing.add_class(spark, n("C")), editing.add_subclass(spark, n("C"), n("D")), editing.add_object_property(spark, n("p")), editing.add_data_property(spark, n("d")), editing.add_subproperty(spark, n("p"), n("q"))]
    want = [(n("i"), V.TYPE, n("C")), (n("C"), V.TYPE, V.CLASS), (n("C"), V.SUBCLASS, n("D")), (n("p"), V.TYPE, V.OBJECT_PROPERTY), (n("d"), V.TYPE, V.DATA_PROPERTY), (n("p"), V.SUBPROPERTY, n("q"))]
    graph = triples(spark, [])
    for m in made:
        graph = changes.apply_batch(graph, m)
    assert rows(graph) == sorted(want, key=str)
    assert rows(changes.apply_batch(graph, editing.changed(spark, ("remove", *want[0]), ("add", *want[0])))) == sorted(want, key=str)
    assert rows(changes.apply_batch(graph, editing.changed(spark, ("remove", *want[0])))) == sorted(want[1:], key=str)
    before, after = editing.edit_value(spark, n("i"), n("d"), '"1"', '"2"')
    assert rows(changes.apply_batch(changes.apply_batch(triples(spark, [(n("i"), n("d"), '"1"')]), before), after)) == [(n("i"), n("d"), '"2"')]


def test_iris(spark):
    assert editing.checked_iri("http://e/x") == "<http://e/x>"
    for bad in ("http://e/a b", "<x>", "x", "http://e/\t"):
        with pytest.raises(ValueError, match="IRI"):
            editing.checked_iri(bad)
    taken = lambda *names: triples(spark, [(n(x), n("p"), n("o")) for x in names])
    fresh = lambda g: editing.unused_iri(g, "http://e/a")
    assert fresh(taken("b", "a_2")) == n("a") and fresh(taken("a", "a_3", "ab", "a_x")) == n("a_2") and fresh(taken("a", "a_2", "a_4")) == n("a_3")
    assert fresh(taken("a", *[f"a_{k}" for k in range(2, 40)])) == n("a_40") and fresh(taken("a", "a_02")) == n("a_2")
    assert editing.unused_iri(triples(spark, [("_:x", n("a"), '"1"')]), "http://e/a") == n("a_2")
    assert rdf.file_iri("/d/a b.ttl") == "file:///d/a%20b.ttl" and rdf.file_iri("hdfs://h/x") == "hdfs://h/x" and rdf.file_iri("x.ttl").startswith(f"file://{os.getcwd()}")


def test_characteristics_and_annotations(spark):
    graph = triples(spark, [(n("p"), V.TYPE, V.owl("TransitiveProperty")), (n("d"), V.TYPE, V.DATA_PROPERTY)])
    assert rows(editing.toggle_characteristic(graph, n("p"), "Transitive")) == [("remove", n("p"), V.TYPE, V.owl("TransitiveProperty"))]
    assert rows(editing.toggle_characteristic(graph, n("d"), "Functional")) == [("add", n("d"), V.TYPE, V.owl("FunctionalProperty"))]
    for prop, what in ((n("d"), "Symmetric"), (n("p"), "Large")):
        with pytest.raises(ValueError, match="functional only|no characteristic"):
            editing.toggle_characteristic(graph, prop, what)
    note = lambda *a: rows(editing.add_annotation(spark, n("x"), *a))[0][3]
    assert note(V.rdfs("seeAlso"), "https://e.org/a") == "<https://e.org/a>" and note(V.rdfs("seeAlso"), "see a") == '"see a"' and note(V.LABEL, "Haus", "DE") == '"Haus"@de' and note(V.LABEL, "https://e.org/a") == '"https://e.org/a"'
    # the ten properties in common use, in their order
    assert [x.rpartition("/")[2].rpartition("#")[2][:-1] for x in analytics.COMMON_ANNOTATIONS] == ["label", "comment", "seeAlso", "isDefinedBy", "versionInfo", "prefLabel", "altLabel", "definition", "source", "date"]


def test_limits_datasets_and_named_graphs(spark):
    def slow(batches):
        for batch in batches:
            time.sleep(60)
            yield batch

    with pytest.raises(TimeoutError):
        P.within(spark, 2, lambda: spark.range(4).mapInArrow(slow, "id long").count())
    assert P.within(spark, 60, lambda: spark.range(4).count()) == 4
    some, more = P.capped(spark.range(30), 10)
    assert some.count() == 10 and more and not P.capped(spark.range(10), 10)[1]
    reasoned = rules.infer(triples(spark, [(n("x"), V.TYPE, n("A")), (n("A"), V.SUBCLASS, n("B"))]))
    assert P.dataset(reasoned).count() == 3 and P.dataset(reasoned, main=False).count() == 2
    assert P.named_graph(P.dataset(reasoned), n("g")).isEmpty()


def test_conflicts_in_words_and_updates(spark):
    graph = triples(spark, [(n("A"), V.DISJOINT, n("B")), (n("x"), V.TYPE, n("A"))])
    reasoned = rules.infer(graph)
    assert rules.consistent(reasoned)
    log = lambda *r: spark.createDataFrame([(i, 1, *x) for i, x in enumerate(r)], "seq long, batch long, op string, s string, p string, o string")
    worse = rules.update(graph, reasoned, log(("add", n("x"), V.TYPE, n("B"))))
    assert not rules.consistent(worse)
    assert [r["text"] for r in rules.described(rules.conflicts(worse)).collect()] == [f"{n('x')} is in two disjoint classes, {n('A')} and {n('B')}"]
    asserted = worse.select("s", "p", "o")
    better = rules.update(asserted, worse, log(("remove", n("x"), V.TYPE, n("B"))))
    assert rules.consistent(better) and rows(better.select("s", "p", "o")) == rows(graph)
    # without a result yet, and additions to a consistent one
    assert rows(rules.update(graph, None, log(("add", n("A"), V.SUBCLASS, n("C")))).filter("level > 0").select("s", "o")) == [(n("x"), n("C"))]
    assert rows(rules.update(graph, reasoned, log(("add", n("A"), V.SUBCLASS, n("C")))).filter("level > 0").select("s", "o")) == [(n("x"), n("C"))]


def test_explanations_with_budgets_and_depth(spark):
    reasoned = rules.infer(triples(spark, [(n("x"), V.TYPE, n("A")), *[(n(a), V.SUBCLASS, n(b)) for a, b in ("AB", "BC")]]), only={"cax-sco"})
    target = reasoned.filter(F.col("o") == n("C")).filter(F.col("p") == V.TYPE)
    whole = rules.explain(reasoned, target)
    assert rows(rules.depth(whole).filter(F.col("p") == V.TYPE).select("o", "depth")) == [(n("A"), 0), (n("B"), 1), (n("C"), 2)]
    assert {r["rule"] for r in rules.explain(reasoned, target, max_facts=0).collect()} == {"truncated"}
    assert rows(rules.explain(reasoned, target, max_steps=1).select("rule", "o")) == [("cax-sco", n("C")), ("truncated", n("B")), ("truncated", n("C"))]
    assert rows(rules.justification(whole)) == rows(reasoned.filter("level = 0").select("s", "p", "o"))
    ways = rules.chain_path(triples(spark, [(n("a"), n("p"), n("b")), (n("a"), n("p"), n("c")), (n("b"), n("q"), n("d")), (n("c"), n("q"), n("d")), (n("c"), n("q"), n("e"))]), [n("p"), n("q")], n("a"), n("d"))
    assert rows(ways) == [([n("a"), n("b"), n("d")],), ([n("a"), n("c"), n("d")],)]
