"""Terms, pattern algebra, paths, class expressions, analytics, changes and files on small graphs."""

import tempfile

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loomgraph import vocab as V
from loomgraph.functions import terms
from loomgraph.operators import analytics, changes, expressions as X, patterns as P
from loomgraph.plans.components import components
from loomgraph.plans.shared import attach, prefix_sums
from loomgraph.sources.lift import name as n, triples
from loomgraph.sources.ntriples import read_ntriples, write_ntriples

INT = f"^^<{V.XSD}integer>"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


TEXTS = ["", "a@b.c", "x^^<y>", 'quo"te', "back\\slash\\n", "line\nbreak\t", "\\", '"', "한글 ñ", "x" * 20_000 + "\n" * 3000, ' . # "', "a . # b"]


def test_literals_come_back_from_terms_and_files(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for make, kind, tag in ((terms.literal(F.col("t")), f"{V.XSD}string", ""), (terms.literal(F.col("t"), lang="ko"), f"{V.RDF}langString", "ko"), (terms.integer(F.col("t")), f"{V.XSD}integer", "")):
        made = df.select("t", make.alias("k"))
        for r in made.select("t", terms.lex(F.col("k")).alias("l"), terms.datatype(F.col("k")).alias("d"), terms.lang(F.col("k")).alias("g"), terms.kind(F.col("k")).alias("kind")).collect():
            assert (r["l"], r["d"], r["g"], r["kind"]) == (r["t"], kind, tag, "literal")
    graph = df.select(F.concat(F.lit("<urn:x/"), "i", F.lit(">")).alias("s"), F.lit("<urn:p>").alias("p"), terms.literal(F.col("t")).alias("o")).unionByName(triples(spark, [("_:b", "<urn:p>", "_:c"), ("_:b", "<urn:p>", f'"1"{INT}')]))
    path = tempfile.mkdtemp() + "/nt"
    write_ntriples(graph.unionByName(triples(spark, [('"literal"', "<urn:p>", "<urn:o>")])), path)
    # blank nodes come back under the graph's labels
    plain = lambda c: F.regexp_replace(c, r"^_:g[0-9a-f]{32}\.l", "_:").alias(c)
    assert rows(read_ntriples(spark, path).select(*map(plain, "spo"))) == rows(graph)


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=20))
def test_any_text_is_a_literal(spark, text):
    made = spark.range(1).select(terms.literal(F.lit(text)).alias("k"))
    assert made.select(terms.lex(F.col("k"))).first()[0] == text


def test_bad_lines(spark):
    path = tempfile.mkdtemp()
    with open(f"{path}/a.nt", "w") as f:
        f.write('# note\n\n<urn:a> <urn:p> <urn:b> . # tail\n<urn:a> <urn:p> "un"quoted" .\n')
    assert rows(read_ntriples(spark, path, strict=False)) == [("<urn:a>", "<urn:p>", "<urn:b>")]
    with pytest.raises(Exception, match="not N-Triples"):
        read_ntriples(spark, path).collect()


PEOPLE = [
    (n("kim"), V.TYPE, n("Activist")), (n("kim"), V.TYPE, n("Person")), (n("lee"), V.TYPE, n("Person")), (n("a1"), V.TYPE, n("Activity")), (n("a1"), V.TYPE, n("Event")), (n("a2"), V.TYPE, n("Activity")), (n("a2"), V.TYPE, n("Event")), (n("e1"), V.TYPE, n("Event")),
    (n("a1"), n("by"), n("kim")), (n("a2"), n("by"), n("kim")), (n("a2"), n("by"), n("lee")), (n("a1"), n("year"), f'"1919"{INT}'), (n("a2"), n("year"), f'"1932"{INT}'), (n("e1"), n("year"), f'"1950"{INT}'), (n("e1"), n("note"), '"n"'),
    (n("Activist"), V.SUBCLASS, n("Person")), (n("Activity"), V.SUBCLASS, n("Event")), *[(n(c), V.TYPE, V.CLASS) for c in ("Activist", "Person", "Activity", "Event")], (n("by"), V.TYPE, V.OBJECT_PROPERTY), (n("year"), V.TYPE, V.DATA_PROPERTY),
]


def test_class_expressions(spark):
    graph = triples(spark, PEOPLE).cache()
    person, activist, activity, event = (X.Named(n(c)) for c in ("Person", "Activist", "Activity", "Event"))
    year = lambda *f: X.Some(n("year"), X.Data(f"{V.XSD}integer", f))
    cases = [
        (person, "kim lee"), (person & ~activist, "lee"), (activist | activity, "a1 a2 kim"), (X.OneOf((n("kim"), n("new"))), "kim new"), (X.Some(n("by"), activist), "a1 a2"), (event & X.Value(n("by"), value=n("lee")), "a2"), (X.Min(n("by"), person, n=2), "a2"),
        (activity & X.Only(n("by"), activist), "a1"), (activity & X.Exactly(n("by"), n=1), "a1"), (X.Some(n("by"), activity, inverse=True), "kim lee"), (year((">=", 1910), ("<", 1946)), "a1 a2"), (event & X.Value(n("year"), value=f'"1950"{INT}'), "e1"),
        (X.Min(n("by"), n=0), "a1 a2"), (X.Max(n("by"), n=0), "e1 kim lee"), (X.Only(n("note"), person), "a1 a2 kim lee"), (X.Named(V.THING), "a1 a2 e1 kim lee"), (X.Named(V.NOTHING), ""), (X.Some(n("note"), X.Data(f"{V.XSD}string", ((">", 1),))), ""), (X.Self(n("by")), ""),
    ]
    for expression, want in cases:
        assert rows(expression.find(graph)) == [(n(x),) for x in want.split()], expression
    assert (~activist).closed_world() and X.Max(n("by")).closed_world() and not X.Some(n("by"), activist).closed_world() and (person & X.Only(n("by"))).closed_world()
    assert rows(X.related_classes(graph, [n("Activist")])) == [("super", n("Person"))] and rows(X.related_classes(graph, [n("Event")])) == [("sub", n("Activity"))]
    assert [r["x"] for r in X.instances(person, graph).collect()] == [n("kim"), n("lee")]


def test_optional_minus_values_with_unbound_variables(spark):
    left = spark.createDataFrame([("a", "1"), ("b", None)], "x string, y string")
    right = spark.createDataFrame([("1", "p"), ("2", "q")], "y string, z string")
    assert sorted(map(str, P.optional(left, right, maybe=frozenset(["y"])).collect())) == ["Row(x='a', y='1', z='p')", "Row(x='b', y='1', z='p')", "Row(x='b', y='2', z='q')"]
    assert P.minus(left, right.select("z")).count() == 2
    assert rows(P.values(left, [{"x": "a", "y": None}])) == [("a", "1")]
    assert P.exists(left, right.select("z"), negated=True).count() == 0
    with pytest.raises(ValueError):
        P.join(left, right.select("z"))


def test_paths(spark):
    edges = triples(spark, [(n("1"), n("p"), n("2")), (n("2"), n("p"), n("3")), (n("3"), n("p"), n("1")), (n("1"), n("q"), n("4"))])
    assert P.step(edges, ("plus", n("p"))).count() == 9
    assert P.step(edges, ("star", n("q"))).count() == 5
    assert rows(P.step(edges, ("opt", n("q")))) == rows(P.step(edges, ("star", n("q"))))
    assert rows(P.step(edges, ("not", n("p")))) == [(n("1"), n("4"))]
    assert rows(P.step(edges, ("seq", ("inv", n("p")), n("q")))) == [(n("2"), n("4"))]
    assert P.step(edges, ("alt", n("p"), n("q"))).count() == 4
    ring = spark.createDataFrame([(i, (i + 1) % 30) for i in range(30)], "a int, b int")
    assert P.closure(ring).count() == 900


def test_analytics(spark):
    graph = triples(spark, PEOPLE)
    assert rows(analytics.isolated(graph)) == sorted((x,) for x in (n("by"), n("year"), V.CLASS, V.OBJECT_PROPERTY, V.DATA_PROPERTY))
    kinds = dict(rows(analytics.entity_kinds(graph)))
    assert (kinds[n("kim")], kinds[n("Person")], kinds[n("by")], kinds[n("year")], kinds[n("note")]) == ("Individual", "Class", "ObjectProperty", "DataProperty", "ObjectProperty")
    types = dict(rows(analytics.node_types(graph)))
    assert (types[n("kim")], types[n("Event")], types['"n"'], types[n("by")]) == ("Individual", "Class", "Literal", "Property")
    loop = triples(spark, [(n(a), V.SUBCLASS, n(b)) for a, b in (("b", "a"), ("c", "b"), ("c", "a"), ("c", "c"), ("x", "y"), ("y", "x"), ("z", "y"))])
    assert rows(analytics.reduced_hierarchy(loop)) == sorted((n(a), n(b)) for a, b in (("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "y")))
    assert rows(analytics.hierarchy_roots(loop, spark.createDataFrame([(n("w"),)], "x string"))) == [(n("a"),), (n("w"),), (n("x"),)]
    assert rows(analytics.visible(loop, "c>")) == [(n("a"),), (n("b"),), (n("c"),)]
    near = dict(rows(analytics.neighbourhood(graph, spark.createDataFrame([(n("lee"),)], "x string"), 2)))
    assert near[n("lee")] == 0 and near[n("a2")] == 1 and near[n("kim")] == 2


def test_changes(spark):
    log = spark.createDataFrame([(1, 1, "add", "a", "p", "b"), (2, 1, "add", "a", "p", "c"), (3, 2, "remove", "a", "p", "b"), (4, 3, "add", "a", "p", "c")], "seq long, batch long, op string, s string, p string, o string")
    none = log.limit(0)
    now = changes.replay(none, log)
    assert rows(now) == [("a", "p", "c")]
    assert rows(changes.undo(now, log)) == []  # undoing a redundant addition takes the triple away
    assert rows(changes.undo(now, log, 2)) == [("a", "p", "b")]
    graph = triples(spark, PEOPLE)
    assert changes.delete_entity(graph, n("kim")).count() == len(PEOPLE) - 4
    assert rows(changes.difference(changes.delete_entity(graph, n("kim")), graph).select("op").distinct()) == [("add",)]
    with pytest.raises(ValueError):
        changes.rename(graph, n("kim"), n("lee"))
    assert changes.rename(graph, n("kim"), n("kim9")).filter(F.col("o") == n("kim9")).count() == 2
    nested = triples(spark, [("_:a", "p", "_:b"), ("_:b", "p", "_:c"), ("x", "p", "_:s"), ("_:c", "p", "_:s")])
    assert changes.structure(nested, spark.createDataFrame([("_:a",)], "x string")).count() == 3


def test_plan_helpers(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(None, None)], "id long, k string")
    counted = left.filter("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    out = attach(left, counted, "k", "n", "id")
    assert out.count() == 301 and rows(out.filter("k = 'hot'").select("first").distinct()) == [(1,)] and out.filter("k is null and first is not null").isEmpty()
    summed = prefix_sums(left.filter("k is not null"), ["k"], ["id"], F.lit(1), "at").filter("k = 'hot'")
    assert sorted(r["at"] for r in summed.collect()) == list(range(200))
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (3, 3), (7, 7), (10, 4)], "a long, b long")
    assert rows(components(edges)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (10, 4)]
