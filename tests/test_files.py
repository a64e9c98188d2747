"""Graphs in files: blank nodes over several parts, references, nesting, imports by levels, catalogs, tab-separated lines."""

import uuid

import pytest

from loomgraph import vocab as V
from loomgraph.sources import rdf
from loomgraph.sources.ntriples import read_ntriples, write_ntriples

P, Q, R = "<http://e/p>", "<http://e/q>", "<http://e/r>"


def restrictions(spark, n=40):
    rows = [t for i in range(n) for t in ((f"<http://e/s{i}>", P, f"_:b{i}"), (f"_:b{i}", Q, f"_:c:{i}"), (f"_:c:{i}", R, f'"{i}"'))]
    return spark.createDataFrame(rows, "s string, p string, o string")


def ways(graph):
    a, b, c = (graph.filter(graph["p"] == p).select("s", "o") for p in (P, Q, R))
    found = a.toDF("s", "x").join(b.toDF("x", "y"), "x").join(c.toDF("y", "o"), "y")
    return sorted((r["s"], r["o"]) for r in found.select("s", "o").collect())


@pytest.mark.parametrize("kind", ["turtle", "rdfxml", "ntriples"])
def test_blank_nodes_of_part_files(spark, tmp_path, kind):
    write = {"turtle": lambda g, p: rdf.write_turtle(g, p, parts=8), "rdfxml": lambda g, p: rdf.write_rdfxml(g, p, parts=8), "ntriples": lambda g, p: write_ntriples(g.repartition(8), p)}[kind]
    read = read_ntriples if kind == "ntriples" else rdf.read_rdf
    graph = restrictions(spark)
    one, two, again = (str(tmp_path / x) for x in ("one", "two", "again"))
    write(graph, one)
    write(graph, two)
    assert len(list((tmp_path / "one").glob("part-*"))) >= 4
    want = ways(graph)
    assert len(want) == 40 and ways(read(spark, one)) == want
    assert ways(read(spark, [one, two])) == sorted(want * 2)  # two graphs never share a node
    write(read(spark, one).unionByName(read(spark, two)), again)
    assert ways(read(spark, again)) == sorted(want * 2)


def test_foreign_ntriples_name_nodes_by_file(spark, tmp_path):
    for x in "ab":
        (tmp_path / f"{x}.nt").write_text(f"<http://e/{x}> {P} _:n .\n_:n {Q} \"{x}\" .\n")
    found = read_ntriples(spark, [str(tmp_path / f"{x}.nt") for x in "ab"])
    left, right = (found.filter(found["p"] == p) for p in (P, Q))
    assert sorted((r[0], r[1]) for r in left.toDF("s", "p", "n").join(right.toDF("n", "q", "o"), "n").select("s", "o").collect()) == [("<http://e/a>", '"a"'), ("<http://e/b>", '"b"')]


def test_labels_and_nodes_without_one_stay_apart():
    found = rdf.parse_turtle("@prefix e: <http://e/> . _:g1 e:p e:x . e:a e:q [ e:r e:s ] .", "http://b/", "m")
    assert len({s for s, _, _ in found if s.startswith("_:")}) == 2
    xml = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><rdf:Description rdf:nodeID="g1"><e:p/></rdf:Description><rdf:Description><e:p/></rdf:Description></rdf:RDF>'
    assert len({s for s, _, _ in rdf.parse_rdfxml(xml, "http://b/", "m")}) == 2


def test_references():
    base = "http://a/b/c/d;p?q"
    # the examples of RFC 3986, 5.4
    want = {"g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "..": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../../g": "http://a/g", "g;x=1/../y": "http://a/b/c/y", "#": "http://a/b/c/d;p?q#", "http://z/x#": "http://z/x#", "urn:a:b": "urn:a:b"}
    assert {r: rdf.resolved(base, r) for r in want} == want
    assert rdf.resolved("s3a://bucket/x/y.ttl", "#A") == "s3a://bucket/x/y.ttl#A" and rdf.resolved("file:/d/y.ttl", "z.ttl") == "file:/d/z.ttl" and rdf.resolved("http://a", "g") == "http://a/g"
    assert rdf.parse_turtle("@base <http://e.org/> . @prefix e: <http://e.org/ns#> . @prefix l: <#> . e:A e:p l:B .", "http://b/") == [("<http://e.org/ns#A>", "<http://e.org/ns#p>", "<http://e.org/#B>")]
    xml = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:base="http://e.org/"><rdf:Seq rdf:about="http://e.org/s#"><e:label>x</e:label><rdf:li>a</rdf:li><e:label>y</e:label><rdf:li>b</rdf:li></rdf:Seq></rdf:RDF>'
    found = rdf.parse_rdfxml(xml, "http://b/")
    assert {s for s, _, _ in found} == {"<http://e.org/s#>"} and [(p, o) for _, p, o in found if "_" in p] == [(f"<{V.RDF}_1>", '"a"'), (f"<{V.RDF}_2>", '"b"')]


def test_deep_nesting_and_bad_files(spark, tmp_path):
    (tmp_path / "deep.ttl").write_text("@prefix e: <http://e/> . e:a e:p " + "[ e:p " * 3000 + "1" + " ]" * 3000 + " .")
    (tmp_path / "bad.ttl").write_text("e:a e:b")
    (tmp_path / "endless.ttl").write_text("<http://e/a> <http://e/p> " + "[ <http://e/p> " * 60_000)
    assert rdf.read_rdf(spark, str(tmp_path / "deep.ttl")).count() == 3001
    assert rdf.read_rdf(spark, str(tmp_path), strict=False).count() == 3001
    with pytest.raises(Exception, match="no prefix"):
        rdf.read_rdf(spark, str(tmp_path / "bad.ttl")).collect()


def jobs(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, group)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_imports_by_levels_catalogs_and_errors(spark, tmp_path):
    imports = "<http://www.w3.org/2002/07/owl#imports>"

    def tree(top, width):
        top.mkdir()
        (top / "root.ttl").write_text("<http://e/o> a <http://www.w3.org/2002/07/owl#Ontology> . " + " ".join(f"<http://e/o> {imports} <http://e/k{i}> ." for i in range(width)))
        for i in range(width):
            (top / f"k{i}.nt").write_text(f"<http://e/k{i}> {imports} <http://e/deep> .\n<http://e/k{i}> {imports} <http://e/o> .\n<http://e/k{i}> {P} _:b .\n")
        (top / "deep.ttl").write_text(f"<http://e/deep> {P} 1 . <http://e/deep> {imports} <http://e/k0>, <http://e/gone>, <http://e/named>, <http://e/broken> .")
        (top / "else where.owl").write_text(f"<http://e/named> {P} 2 .")
        (top / "broken.ttl").write_text("x y z")
        (top / "catalog-v001.xml").write_text('<catalog xmlns="urn:oasis:names:tc:entity:xmlns:xml:catalog"><uri name="http://e/named" uri="else where.owl"/></catalog>')
        return str(top / "root.ttl")

    (few, n_few), (many, n_many) = (jobs(spark, lambda w=w: rdf.load(spark, tree(tmp_path / f"t{w}", w))) for w in (2, 9))
    assert n_few == n_many  # jobs grow with the depth
    triples, states = many
    assert [(s.iri, s.depth) for s in states if s.depth == 1] == [(f"http://e/k{i}", 1) for i in range(9)]
    by = {s.iri: s for s in states}
    assert len(states) == 13 and by["http://e/deep"].depth == 2 and by["http://e/deep"].triples == 5 and by["http://e/named"].depth == 3 and by["http://e/named"].source.endswith("else where.owl")
    assert by["http://e/gone"].error == "not found" and "where an IRI belongs" in by["http://e/broken"].error
    got = {r["origin"]: r["n"] for r in triples.groupBy("origin").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert got == {"asserted": 10, "imported": 9 * 3 + 5 + 1}
    assert triples.filter(triples["o"].startswith("_:")).select("o").distinct().count() == 9
    with pytest.raises(ValueError, match="more than 3"):
        rdf.load(spark, str(tmp_path / "t9" / "root.ttl"), max_imports=3)


def test_tab_separated(spark, tmp_path):
    rows = spark.createDataFrame([("<http://e/a>", '"x\ty\\nz"@en'), (None, '"1"^^<http://www.w3.org/2001/XMLSchema#integer>'), ("_:b", None)], "s string, `o p` string")
    rdf.write_tsv(rows.coalesce(1), str(tmp_path / "t"))
    assert sorted(map(tuple, rdf.read_tsv(spark, str(tmp_path / "t")).collect())) == [("", "1"), ("_:b", ""), ("http://e/a", "x y z")]
    head = next((tmp_path / "t").glob("part-*")).read_text().split("\n")[0]
    assert head == "s\to p"


@pytest.mark.parametrize("kind", ["turtle", "rdfxml"])
def test_written_documents_stay_small(spark, tmp_path, kind):
    write = rdf.write_turtle if kind == "turtle" else rdf.write_rdfxml
    graph = spark.range(12_000).selectExpr("concat('<http://e/', id div 3, '>') as s", f"'{P}' as p", "concat('\"', id, repeat('long text ', 200), '\"') as o")
    write(graph, str(tmp_path / "g"), parts=1)
    sizes = [x.stat().st_size for x in (tmp_path / "g").glob("part-*")]
    assert len(sizes) > 2 and max(sizes) < 9 << 20
    found = rdf.read_rdf(spark, str(tmp_path / "g"))
    assert found.count() == 12_000 and found.exceptAll(graph).isEmpty()


def test_documents_are_read_in_parts(spark, tmp_path):
    node = '<rdf:Description rdf:about="http://e/{}"><e:p>x</e:p></rdf:Description>'
    xml = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/" xml:lang="en">' + "".join(map(node.format, range(30_000)))
    turtle = "".join(f'<http://e/{i}> {P} "x"@en .\n' for i in range(30_000))
    for parts in (rdf.rdfxml_parts(xml + "</rdf:RDF>", "http://b/"), rdf.turtle_parts(turtle, "http://b/")):
        found = list(parts)
        assert len(found) > 2 and [t for part in found for t in part] == [(f"<http://e/{i}>", P, '"x"@en') for i in range(30_000)]
    (tmp_path / "broken.rdf").write_text(xml)
    (tmp_path / "fine.ttl").write_text(f"<http://e/s> {P} <http://e/o> .")
    assert [tuple(r) for r in rdf.read_rdf(spark, str(tmp_path), strict=False).collect()] == [("<http://e/s>", P, "<http://e/o>")]


def test_ntriples_lines_are_parsed_once_whatever_is_asked_of_them(spark, tmp_path):
    """A filter of a pattern does not work the line out again, and a text may hold what Unicode calls line ends."""
    from loomgraph.sources.ntriples import load_ntriples

    text = '"one two\u0085three # . \\" . "'
    lines = [f"<http://e/s> {P} {text} . # said", f"\t<http://e/s>  {Q}\t<http://e/x.y>.", "_:b <http://e/r> \"7\"^^<http://www.w3.org/2001/XMLSchema#string> .", "# no triple", " "]
    (tmp_path / "g.nt").write_text("\n".join(lines), encoding="utf-8")
    path = str(tmp_path / "g.nt")
    found = load_ntriples(spark, path)
    assert sorted((r["p"], r["o"]) for r in found.select("p", "o").collect()) == [(P, text), (Q, "<http://e/x.y>"), (R, '"7"')]
    plan = read_ntriples(spark, path).filter(f"p = '{P}' and o is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(value") == 1
