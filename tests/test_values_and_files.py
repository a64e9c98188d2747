"""Value functions and RDF files on small cases."""

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import terms
from loomgraph.functions import values as X
from loomgraph.sources import rdf

XSD = "http://www.w3.org/2001/XMLSchema#"


def typed(text, kind):
    return f'"{text}"^^<{XSD}{kind}>'


def test_values(spark):
    i, d, e, t = (F.lit(typed(*x)) for x in (("7", "integer"), ("2.50", "decimal"), ("1e2", "double"), ("2024-02-29T23:59:01.5+05:30", "dateTime")))
    s, g, n = F.lit('"a\\"b\\\\n"'), F.lit('"Haus"@de'), F.lit(None).cast("string")
    cells = {
        "sum": (X.add(i, d), typed("9.5", "decimal")), "quotient": (X.divide(i, F.lit(typed("2", "integer"))), typed("3.5", "decimal")), "none": (X.divide(i, F.lit(typed("0", "integer"))), None), "real": (X.multiply(d, e), typed("250.0", "double")),
        "words": (X.add(i, s), None), "minus": (X.negative(i), typed("-7", "integer")), "upper": (X.ucase(g), '"HAUS"@de'), "size": (X.strlen(s), typed("5", "integer")), "second": (X.seconds(t), typed("1.5", "decimal")), "zone": (X.timezone(t), typed("PT5H30M", "dayTimeDuration")),
        "tz": (X.tz(t), '"+05:30"'), "int": (X.to_integer(F.lit(typed("-3.9", "decimal"))), typed("-3", "integer")), "bad": (X.to_integer(s), None), "bool": (X.to_boolean(e), typed("true", "boolean")), "iri": (X.iri(F.lit('"http://x"')), "<http://x>"), "tag": (X.strlang(F.lit('"x"'), "EN"), '"x"@en'),
        "uri": (X.encode_for_uri(F.lit('"a b*~/"')), '"a%20b%2A~%2F"'), "before": (X.strbefore(g, F.lit('"u"')), '"Ha"@de'), "after": (X.strafter(g, F.lit('"q"')), '""'), "text": (X.str_(n), None), "round": (X.round_(F.lit(typed("-2.5", "decimal"))), typed("-2", "integer").replace("integer", "decimal")),
    }
    row = spark.range(1).select(*[c.alias(k) for k, (c, _) in cells.items()]).first()
    assert row.asDict() == {k: v for k, (_, v) in cells.items()}
    tests = {
        "eq": (X.equal(i, F.lit(typed("7.0", "decimal"))), True), "ne": (X.equal(s, g), False), "unknown": (X.equal(F.lit('"a"^^<u:t>'), F.lit('"b"^^<u:t>')), None), "less": (X.less(i, e), True), "odd": (X.less(i, s), None), "in": (X.one_of(i, s, F.lit(typed("07", "integer"))), True),
        "empty": (X.condition(F.lit('""')), False), "lang": (X.lang_matches(terms.lang(g), "DE"), True), "blank": (X.is_blank(F.lit("_:x")), True), "lex": (terms.lex(s) == F.lit('a"b\\n'), True),
    }
    assert spark.range(1).select(*[c.alias(k) for k, (c, _) in tests.items()]).first().asDict() == {k: v for k, (_, v) in tests.items()}


def test_turtle_and_rdfxml():
    text = '@prefix e: <http://e/> . e:a e:p "x"@EN, 1.5 ; e:q ( 1 _:b ) . [] a e:C .'
    found = rdf.parse_turtle(text, "http://base/", "m")
    assert ("<http://e/a>", "<http://e/p>", '"x"@en') in found and ("<http://e/a>", "<http://e/p>", typed("1.5", "decimal")) in found and len(found) == 8
    with pytest.raises(ValueError, match="no prefix"):
        rdf.parse_turtle("f:a f:b f:c .", "http://base/")
    xml = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><e:C rdf:about="http://e/a"><e:p rdf:resource="b"/><e:q xml:lang="en">t</e:q></e:C></rdf:RDF>'
    assert rdf.parse_rdfxml(xml, "http://base/") == [("<http://e/a>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<http://e/C>"), ("<http://e/a>", "<http://e/p>", "<http://base/b>"), ("<http://e/a>", "<http://e/q>", '"t"@en')]
    assert rdf.sniffed("﻿ <?xml version='1.0'?><rdf:RDF/>", "x.ttl") == "rdfxml" and rdf.sniffed("@prefix", "x.owl") == "turtle" and rdf.format_of("a.nt") == "ntriples"
    with pytest.raises(ValueError, match="Manchester"):
        rdf.sniffed("Prefix: x", "x.omn")
    assert rdf.places("http://e/v1.0", "/d", {}) == ["/d/v1.0"] and rdf.places("file:///d/a%20b.ttl", "/d", {}) == ["file:///d/a b.ttl"]
    assert rdf.places("http://e/o#", "/d", {"http://e/o#": "/c/o.ttl"})[:2] == ["/c/o.ttl", "/d/o"] and rdf.read_catalog('<catalog><uri name="i" uri="f.ttl"/></catalog>', "/d") == {"i": "/d/f.ttl"}
