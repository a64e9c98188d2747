"""RDF files: Turtle and RDF/XML, which aren't split by lines, one file to a task and many at once; formats, bases and imports."""

from __future__ import annotations

import math
import os
import re
import sys
import urllib.parse
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import vocab as V
from loomgraph.functions import terms
from loomgraph.plans.shared import stage
from loomgraph.sources.blank import blank_name, graph_label, mark_of, scoped
from loomgraph.sources.ntriples import line_triples

Triple = tuple[str, str, str]
_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + V.RDF + "}"


def format_of(path: str) -> str:
    """ntriples, rdfxml or turtle, by the extension."""
    return {"nt": "ntriples", "owl": "rdfxml", "rdf": "rdfxml", "xml": "rdfxml"}.get(path.rsplit(".", 1)[-1].lower(), "turtle")


def sniffed(text: str, path: str) -> str:
    """The format by the beginning of a text, else by the extension. Syntaxes that aren't RDF raise."""
    head = text[:4096].lstrip("\ufeff").lstrip()
    if head.startswith("<?xml") or re.match(r"<!--|<!DOCTYPE|<rdf:RDF|<Ontology", head):
        if re.search(r"<Ontology[\s>]", head) and "rdf:RDF" not in head:
            raise ValueError(f"{path} is OWL/XML, which isn't read")
        return "rdfxml"
    if re.match(r"(Prefix:|Ontology:)", head):
        raise ValueError(f"{path} is in Manchester syntax, which isn't read")
    if re.match(r"(Prefix\(|Ontology\()", head):
        raise ValueError(f"{path} is in functional syntax, which isn't read")
    found = format_of(path)
    return "turtle" if found == "rdfxml" else found


def file_iri(path: str) -> str:
    """The base IRI of a file."""
    return path if _ABSOLUTE.match(path) else "file://" + urllib.parse.quote(os.path.abspath(path))


_ABSOLUTE = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def resolved(base: str, reference: str) -> str:
    """A reference against a base IRI of any scheme; absolute ones stay as they are, and an empty query or fragment stays."""
    parts = re.match(r"([A-Za-z][A-Za-z0-9+.-]*:)(//[^/?#]*)?([^?#]*)(\?[^#]*)?", base)
    if _ABSOLUTE.match(reference) or not parts:
        return reference
    scheme, host, path, query = parts.groups(default="")
    if reference.startswith("//"):
        return scheme + reference
    if not reference or reference[0] == "#":
        return scheme + host + path + query + reference
    own, rest = re.match(r"([^?#]*)(.*)", reference, re.S).groups()
    if not own:
        return scheme + host + path + reference
    whole = own if own[0] == "/" else path[: path.rfind("/") + 1] + own if "/" in path else f"/{own}" if host else own
    steps: list[str] = []
    for step in whole.split("/"):
        if step == ".." and len(steps) > 1:
            steps.pop()
        elif step not in (".", ".."):
            steps.append(step)
    if whole.rpartition("/")[2] in (".", ".."):
        steps.append("")
    return scheme + host + "/".join(steps) + rest


_TOKEN = re.compile(
    r'\s+|#[^\n]*|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*\'\'\')|(?P<text>"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)'
    r"|(?P<word>@(?:prefix|base)\b)|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)|(?P<blank>_:[\w](?:[\w.-]*[\w-])?)|(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))"
    r"|(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[^\w\s])(?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\[^\w\s])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[^\w\s]))?)?)|(?P<key>[A-Za-z]+)|(?P<mark>[][().;,])",
    re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _plain(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), text, flags=re.S)


def literal(text: str, datatype: str | None = None, lang: str | None = None) -> str:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(a, b)
    return f'"{text}"' + (f"@{lang.lower()}" if lang else f"^^<{datatype}>" if datatype and datatype != f"{V.XSD}string" else "")


class _Turtle:
    """One document: statements are read one after the other. Blank nodes are named after the document."""

    def __init__(self, text: str, base: str, mark: str) -> None:
        self.tokens, self.base, self.mark, self.prefixes, self.made = self._split(text), base, mark, {}, 0
        self.kind, self.text = next(self.tokens)
        self.out: list[Triple] = []

    def _split(self, text: str) -> Iterator[tuple[str, str]]:
        at = 1 if text.startswith("\ufeff") else 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"not Turtle at {text[at : at + 30]!r}")
            at = m.end()
            if m.lastgroup:
                yield m.lastgroup, m[0]
        while True:
            yield "end", ""

    def take(self, *wanted: str) -> str:
        if wanted and self.text not in wanted:
            raise ValueError(f"{self.text!r} where {' or '.join(wanted)} belongs")
        text = self.text
        self.kind, self.text = next(self.tokens)
        return text

    def iri(self) -> str:
        if self.kind == "iri":
            return f"<{resolved(self.base, _plain(self.take()[1:-1]))}>"
        if self.kind == "name":
            prefix, local = self.take().split(":", 1)
            if prefix not in self.prefixes:
                raise ValueError(f"no prefix {prefix!r}")
            return f"<{self.prefixes[prefix]}{re.sub(r'\\(.)', r'\1', local)}>"
        raise ValueError(f"{self.text!r} where an IRI belongs")

    def fresh(self) -> str:
        self.made += 1
        return f"_:{self.mark}g{self.made}"

    def term(self) -> str:
        kind, text = self.kind, self.text
        if kind == "blank":
            return blank_name(self.take()[2:], self.mark)
        if text == "[":
            self.take()
            node = self.fresh()
            if self.text != "]":
                self.properties(node)
            self.take("]")
            return node
        if text == "(":
            self.take()
            items = []
            while self.text != ")":
                items.append(self.term())
            self.take(")")
            cells = [self.fresh() for _ in items]
            for cell, item, rest in zip(cells, items, [*cells[1:], V.NIL], strict=True):
                self.out += [(cell, V.FIRST, item), (cell, V.REST, rest)]
            return cells[0] if cells else V.NIL
        if kind in ("text", "long"):
            value = _plain(self.take()[3:-3] if kind == "long" else self.take()[1:-1])
            if self.kind == "lang":
                return literal(value, lang=self.take()[1:])
            if self.kind == "type":
                self.take()
                return literal(value, self.iri()[1:-1])
            return literal(value)
        if kind == "number":
            return literal(self.take(), V.XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if kind == "key" and text in ("true", "false"):
            return literal(self.take(), f"{V.XSD}boolean")
        return self.iri()

    def properties(self, subject: str) -> None:
        while True:
            if self.text == "a" and self.kind == "key":
                self.take()
                verb = V.TYPE
            else:
                verb = self.iri()
            self.out.append((subject, verb, self.term()))
            while self.text == ",":
                self.take()
                self.out.append((subject, verb, self.term()))
            while self.text == ";":
                self.take()
                if self.text not in (";", ".", "]"):
                    break
            else:
                return
            if self.text in (".", "]"):
                return

    def read(self) -> Iterator[list[Triple]]:
        """The triples in parts, each after a statement."""
        while self.kind != "end":
            word = self.text.lower().lstrip("@")
            if self.kind in ("word", "key") and word in ("prefix", "base"):
                at = self.take().startswith("@")
                if word == "prefix":
                    name = self.take()[:-1]
                    self.prefixes[name] = self.iri()[1:-1]
                else:
                    self.base = self.iri()[1:-1]
                if at:
                    self.take(".")
                continue
            alone = self.text == "["
            subject = self.term()
            if not (alone and self.text == "."):
                self.properties(subject)
            self.take(".")
            if len(self.out) >= PART_TRIPLES:
                yield self.out
                self.out = []
        yield self.out


#: Triples of a document that are passed on together.
PART_TRIPLES = 10_000


def turtle_parts(text: str, base: str, mark: str = "") -> Iterator[list[Triple]]:
    return _Turtle(text, base, mark).read()


def parse_turtle(text: str, base: str, mark: str = "") -> list[Triple]:
    return [t for part in turtle_parts(text, base, mark) for t in part]


def parse_rdfxml(text: str, base: str, mark: str = "") -> list[Triple]:
    return [t for part in rdfxml_parts(text, base, mark) for t in part]


def rdfxml_parts(text: str, base: str, mark: str = "") -> Iterator[list[Triple]]:
    """Node and property elements, typed nodes, collections, reification of statements by rdf:ID; rdf:li counts members. Top elements are let go as soon as they are read."""
    out: list[Triple] = []
    made = [0]

    def fresh() -> str:
        made[0] += 1
        return f"_:{mark}g{made[0]}"

    def named(tag: str) -> str:
        return "<" + tag[1:].replace("}", "", 1) + ">"

    def about(value: str, base: str) -> str:
        return f"<{resolved(base, value)}>"

    def node(e: ET.Element, base: str, lang: str | None) -> str:
        base, lang = e.get(f"{_XML}base", base), e.get(f"{_XML}lang", lang)
        a = e.attrib
        s = about(a[f"{_R}about"], base) if f"{_R}about" in a else about("#" + a[f"{_R}ID"], base) if f"{_R}ID" in a else blank_name(a[f"{_R}nodeID"], mark) if f"{_R}nodeID" in a else fresh()
        if e.tag != f"{_R}Description":
            out.append((s, V.TYPE, named(e.tag)))
        attributes(s, a, base, lang)
        members(s, e, base, lang)
        return s

    def members(s: str, e: ET.Element, base: str, lang: str | None) -> None:
        """Property elements; those that are rdf:li are numbered among themselves."""
        k = 0
        for child in e:
            k += child.tag == f"{_R}li"
            one(s, child, base, lang, k)

    def attributes(s: str, a: dict, base: str, lang: str | None) -> None:
        for name, value in a.items():
            if name == f"{_R}type":
                out.append((s, V.TYPE, about(value, base)))
            elif name.startswith("{") and not name.startswith((_XML, _R)):
                out.append((s, named(name), literal(value, lang=lang)))

    def one(s: str, e: ET.Element, base: str, lang: str | None, k: int) -> None:
        base, lang = e.get(f"{_XML}base", base), e.get(f"{_XML}lang", lang)
        p, kind, a = f"<{V.RDF}_{k}>" if e.tag == f"{_R}li" else named(e.tag), e.get(f"{_R}parseType"), e.attrib
        if kind == "Collection":
            items = [node(c, base, lang) for c in e]
            cells = [fresh() for _ in items]
            for cell, item, rest in zip(cells, items, [*cells[1:], V.NIL], strict=True):
                out.extend([(cell, V.FIRST, item), (cell, V.REST, rest)])
            o = cells[0] if cells else V.NIL
        elif kind == "Resource":
            o = fresh()
            members(o, e, base, lang)
        elif kind == "Literal":
            o = literal((e.text or "") + "".join(ET.tostring(c, "unicode") for c in e), f"{V.RDF}XMLLiteral")
        elif f"{_R}resource" in a or f"{_R}nodeID" in a:
            o = about(a[f"{_R}resource"], base) if f"{_R}resource" in a else blank_name(a[f"{_R}nodeID"], mark)
            attributes(o, a, base, lang)
        elif len(e):
            o = node(e[0], base, lang)
        elif any(n.startswith("{") and not n.startswith((_XML, _R)) for n in a):
            o = fresh()
            attributes(o, a, base, lang)
        else:
            o = literal(e.text or "", a.get(f"{_R}datatype"), None if f"{_R}datatype" in a else lang or None)
        out.append((s, p, o))
        if f"{_R}ID" in a:
            r = about("#" + a[f"{_R}ID"], base)
            out.extend([(r, V.TYPE, V.rdf("Statement")), (r, V.rdf("subject"), s), (r, V.rdf("predicate"), p), (r, V.rdf("object"), o)])

    parser, depth, top, lang = ET.XMLPullParser(("start", "end")), 0, None, None

    def read() -> None:
        nonlocal depth, top, base, lang
        for event, e in parser.read_events():
            if event == "start":
                if top is None:
                    top, base, lang = e, e.get(f"{_XML}base", base), e.get(f"{_XML}lang")
                depth += 1
                continue
            depth -= 1
            if top.tag == f"{_R}RDF" and depth == 1:
                node(e, base, lang)
                top.remove(e)
            elif top.tag != f"{_R}RDF" and not depth:
                node(top, base, lang)

    for at in range(0, len(text), 1 << 16):
        parser.feed(text[at : at + (1 << 16)])
        read()
        if len(out) >= PART_TRIPLES:
            yield out[:]
            out.clear()
    parser.close()
    read()
    yield out


#: Nested nodes that a document may hold.
MAX_NESTED = 20_000


def _parsed(text: str, where: str, mark: str) -> Iterator[list[Triple]]:
    """A document's triples in parts."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 4 * MAX_NESTED))
    try:
        yield from (rdfxml_parts if sniffed(text, where) == "rdfxml" else turtle_parts)(text, file_iri(where), mark)
    except RecursionError as e:
        raise ValueError(f"nodes nest deeper than {MAX_NESTED}") from e
    finally:
        sys.setrecursionlimit(before)


def _files(spark: SparkSession, path: str | list[str], strict: bool) -> DataFrame:
    """(source, s, p, o, error) of Turtle and RDF/XML files; a file that can't be read raises, or gives one row with its error and no other. Triples are passed on
    in parts as they are read; unless ``strict``, a file is read once before for its errors."""
    schema = pa.schema([(c, pa.string()) for c in ("source", "s", "p", "o", "error")])

    def rows(where: str, found: list[Triple], error: str | None = None) -> pa.RecordBatch:
        columns = zip(*found, strict=True) if found else [[None]] * 3
        n = max(1, len(found))
        return pa.RecordBatch.from_arrays([pa.array([where] * n), *[pa.array(x, pa.string()) for x in columns], pa.array([error] * n, pa.string())], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                where, mark, content = (batch.column(c)[k].as_py() for c in ("path", "mark", "content"))
                try:
                    text = content.decode("utf-8")
                    del content
                    if not strict:
                        for _ in _parsed(text, where, mark):
                            pass
                    for found in _parsed(text, where, mark):
                        for at in range(0, len(found), PART_TRIPLES):
                            yield rows(where, found[at : at + PART_TRIPLES])
                except (ValueError, ET.ParseError) as e:
                    if strict:
                        raise ValueError(f"{where}: {e}") from e
                    yield rows(where, [], str(e).splitlines()[0][:300] or type(e).__name__)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", mark_of(F.col("path")).alias("mark"), "content").mapInArrow(work, "source string, s string, p string, o string, error string")


def read_rdf(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """The set of triples of files or folders in Turtle or RDF/XML, by their beginning and extension; each file is read by one task.

    Blank nodes are named by their file, but for those of a graph that was written in several parts (``blank.SCOPED``), which are the graph's. A file that can't
    be read raises, or drops out unless ``strict``. Files that end in ``.nt`` are better read by ``read_ntriples``, which splits them.
    """
    return _files(spark, path, strict).filter("error is null").select("s", "p", "o").distinct()


# --- writing


def _prefixed(iri: str, prefixes: dict[str, str]) -> str:
    for name, start in prefixes.items():
        if iri[1:-1].startswith(start) and re.fullmatch(r"[A-Za-z_][\w-]*", iri[1 + len(start) : -1]):
            return f"{name}:{iri[1 + len(start) : -1]}"
    return iri


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Triple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in "spo"), strict=True)


#: Characters after which a written document ends, and of the triples that one task puts in order.
DOCUMENT_CHARS, TASK_CHARS = 8 << 20, 64 << 20


def _ordered(triples: DataFrame, parts: int | None) -> DataFrame:
    """In order over all files, with the graph's blank nodes; a subject with very many triples may go on in the next file. ``parts``: how many tasks at least."""
    graph = graph_label()
    rows = triples.filter("not startswith(s, '\"')")
    size = rows.agg(F.sum((F.length("s") + F.length("p") + F.length("o")).cast("long"))).collect()[0][0] or 0
    named = rows.select(scoped(F.col("s"), graph).alias("s"), "p", scoped(F.col("o"), graph).alias("o"))
    return named.repartitionByRange(max(parts or 1, math.ceil(size / TASK_CHARS)), "s", "p", "o").sortWithinPartitions("s", "p", "o")


def _write(ordered: DataFrame, documents: Callable[[Iterator[Triple]], Iterator[str]], path: str) -> None:
    """Each text that ``documents`` makes of a task's triples is a file of its own."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text in documents(_rows(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([text])], ["value"])

    ordered.mapInArrow(work, "value string").write.option("maxRecordsPerFile", 1).text(path)


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str] | None = None, parts: int | None = None) -> None:
    """Turtle files of about DOCUMENT_CHARS at most, each whole by itself: triples by subject and predicate. Those with a literal subject are left out. Blank nodes are the
    graph's in all files. ``parts``: how many files at least."""
    known = {**V.PREFIXES, **(prefixes or {})}

    def shown(term: str) -> str:
        if term.startswith("<"):
            return _prefixed(term, known)
        head, mark, kind = term.rpartition("^^<")
        return f"{head}^^{_prefixed('<' + kind, known)}" if mark and head.endswith('"') and term.startswith('"') else term

    def documents(rows: Iterator[Triple]) -> Iterator[str]:
        head = [f"@prefix {n}: <{i}> ." for n, i in known.items()]
        lines, last, size = [*head], None, 0
        for s, p, o in rows:
            if size > DOCUMENT_CHARS:
                yield "\n".join(lines)
                lines, last, size = [*head], None, 0
            if last and last[0] == s:
                lines[-1] = lines[-1][:-2] + (" ," if last[1] == p else " ;")
                lines.append(f"    {'    ' if last[1] == p else shown(p) + ' '}{shown(o)} .")
            else:
                lines.append(f"{shown(s)} {shown(p)} {shown(o)} .")
            last, size = (s, p), size + len(lines[-1])
        yield "\n".join(lines)

    _write(_ordered(triples, parts), documents, path)


def write_rdfxml(triples: DataFrame, path: str, parts: int | None = None) -> None:
    """RDF/XML files of about DOCUMENT_CHARS at most, each whole by itself. Triples with a literal subject, or a predicate that can't be an element's name, are left
    out. ``parts``: how many files at least."""

    def documents(rows: Iterator[Triple]) -> Iterator[str]:
        quoted = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("\r", "&#13;").replace("\n", "&#10;").replace("\t", "&#9;")
        head = ['<?xml version="1.0" encoding="utf-8"?>', f'<rdf:RDF xmlns:rdf="{V.RDF}">']
        lines, size = [*head], 0
        for s, p, o in rows:
            if size > DOCUMENT_CHARS:
                yield "\n".join([*lines, "</rdf:RDF>"])
                lines, size = [*head], 0
            space, local = re.fullmatch(r"<(.*?)([A-Za-z_][\w.-]*)>", p).groups()
            about = f'rdf:nodeID="{s[2:]}"' if s.startswith("_:") else f'rdf:about="{quoted(s[1:-1])}"'
            if o.startswith('"'):
                text, tail = o[1 : o.rindex('"')], o[o.rindex('"') + 1 :]
                kind = f' xml:lang="{tail[1:]}"' if tail.startswith("@") else f' rdf:datatype="{quoted(tail[3:-1])}"' if tail else ""
                value = f"<x:{local}{kind}>{quoted(_plain(text))}</x:{local}>"
            else:
                value = f'<x:{local} rdf:nodeID="{o[2:]}"/>' if o.startswith("_:") else f'<x:{local} rdf:resource="{quoted(o[1:-1])}"/>'
            lines.append(f'<rdf:Description {about} xmlns:x="{quoted(space)}">{value}</rdf:Description>')
            size += len(lines[-1])
        yield "\n".join([*lines, "</rdf:RDF>"])

    _write(_ordered(triples.filter(F.col("p").rlike(r"^<.*?[A-Za-z_][\w.-]*>$")), parts), documents, path)


def exported(reasoned: DataFrame, with_inferred: bool) -> DataFrame:
    """What is saved of (s, p, o, level, origin): the asserted triples, or those and the inferred ones; imported ones never."""
    origin = F.col("origin") if "origin" in reasoned.columns else F.when(F.col("level") > 0, "inferred").otherwise("asserted")
    return reasoned.filter(origin.isin(["asserted", "inferred"] if with_inferred else ["asserted"])).select("s", "p", "o")


_TSV = {"header": "true", "sep": "\1", "quote": "\0", "escape": "\0", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_tsv(solutions: DataFrame, path: str) -> None:
    """Solutions as tab-separated lines under a head of names: IRIs bare, literals by their text, blank nodes with their mark, tabs and line ends as spaces, unbound as nothing."""
    shown = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(terms.lex(F.col(c)))
    cells = [F.coalesce(F.translate(shown(c), "\t\r\n", "   "), F.lit("")) for c in solutions.columns]
    solutions.select(F.concat_ws("\t", *cells).alias("\t".join(solutions.columns))).write.options(**_TSV).csv(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """The lines of such files by the names in their heads, as plain texts. Blank lines, of one unbound variable alone, are no rows."""
    lines = spark.read.options(**_TSV).csv(path)
    head = lines.columns[0]
    cells = F.split(F.col(f"`{head}`"), "\t", -1)
    return lines.select(*[cells[i].alias(name) for i, name in enumerate(head.split("\t"))])


# --- imports


def import_iris(triples: DataFrame) -> DataFrame:
    """(iri): what a graph imports, in order."""
    return triples.filter((F.col("p") == V.IMPORTS) & F.col("o").startswith("<")).select(F.col("o").alias("iri")).distinct().orderBy("iri")


def ontology_iris(triples: DataFrame) -> DataFrame:
    return triples.filter((F.col("p") == V.TYPE) & (F.col("o") == V.ONTOLOGY) & F.col("s").startswith("<")).select(F.col("s").alias("iri")).distinct().orderBy("iri")


def read_catalog(text: str, folder: str) -> dict[str, str]:
    """IRI to place, of a catalog's ``uri`` elements; places that say no scheme and no root lie in the folder."""
    out = {}
    for e in ET.fromstring(text).iter():
        if e.tag.rpartition("}")[2] == "uri" and e.get("name") and e.get("uri"):
            place = e.get("uri")
            out[e.get("name")] = place if re.match(r"([a-z][a-z0-9+.-]+:|/)", place) else f"{folder}/{place}"
    return out


def places(iri: str, folder: str, catalog: dict[str, str]) -> list[str]:
    """Where an import may lie, in the order of trying: the catalog; a file IRI, its escapes read, and nowhere else; the IRI's last part in the folder, also
    under each extension where it has none."""
    found = [catalog[iri]] if iri in catalog else []
    if iri.startswith("file:"):
        return [*found, "file:///" + urllib.parse.unquote(iri[5:]).lstrip("/")]
    last = iri.rstrip("/#").rpartition("/")[2].rpartition("#")[2]
    more = ("", ".owl", ".ttl", ".rdf", ".nt") if "." not in last.lstrip(".") else ("",)
    return found + [f"{folder}/{last}{x}" for x in more if last]


@dataclass(frozen=True)
class Import:
    """One import's state: where it was found and how many triples it has, or why it wasn't."""

    iri: str
    depth: int
    source: str | None = None
    error: str | None = None
    triples: int = 0


def _found(spark: SparkSession, path: str) -> str | None:
    """The path with its file system, if there is such a file or folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return files.makeQualified(at).toString() if files.exists(at) else None


def catalog_of(spark: SparkSession, folder: str) -> dict[str, str]:
    """What the folder's ``catalog-v001.xml`` says, where there is one."""
    where = _found(spark, f"{folder}/catalog-v001.xml")
    return read_catalog(spark.read.text(where, wholetext=True).collect()[0][0], folder) if where else {}


def _bare(path: Column) -> Column:
    """A path without scheme and escapes, so that those that readers report meet those that were asked for."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/"), r"\+", "%2B")), path)


def _level(spark: SparkSession, sources: list[str]) -> DataFrame:
    """(source, s, p, o, error) of files and folders that all are read by the jobs of one plan; ``source`` is the one that was asked for."""
    lines, others = ([x for x in sources if x.rstrip("/").endswith(".nt") is nt] for nt in (True, False))
    parts = ([line_triples(spark, lines)] if lines else []) + ([_files(spark, others, strict=False)] if others else [])
    rows = reduce(DataFrame.unionByName, parts).withColumn("bare", _bare(F.col("source"))).withColumn("above", F.regexp_replace("bare", "/[^/]*$", ""))
    asked = spark.createDataFrame([(x.rstrip("/"),) for x in sources], "asked string").select("asked", _bare(F.col("asked")).alias("at"))
    met = rows.join(F.broadcast(asked), (F.col("at") == F.col("bare")) | (F.col("at") == F.col("above")))
    return met.select(F.col("asked").alias("source"), "s", "p", "o", "error")


def load(spark: SparkSession, path: str, catalog: dict[str, str] | None = None, fetch: Callable[[str], str | None] | None = None, max_imports: int = 1000) -> tuple[DataFrame, list[Import]]:
    """((s, p, o, origin), imports) of a file, or a folder of parts, and of all that it imports, directly or not.

    The file's triples are "asserted", others "imported"; a triple of both is asserted. A graph that imports itself again is read once. An import
    that isn't found, or can't be read, is listed with its error and left out; the file itself must be readable. ``catalog``: places of IRIs, by default what
    ``catalog-v001.xml`` in a file's folder says. ``fetch`` gives a readable path for an IRI that isn't found nearby; by default nothing is fetched. All imports of one
    depth are read, each once, by one job. The names of imports are read to the driver, their triples never.
    """
    catalogs: dict[str, dict[str, str]] = {}

    def located(iri: str, folder: str) -> str | None:
        if folder not in catalogs:
            catalogs[folder] = catalog if catalog is not None else catalog_of(spark, folder)
        return next((x for p in places(iri, folder, catalogs[folder]) if (x := _found(spark, p))), None) or (fetch(iri) if fetch else None)

    seen: set[str] = set()
    wanted: dict[str, list[str]] = {path.rstrip("/"): []}
    states, paths, depth = [], [], 0
    while wanted:
        staged_path = stage(_level(spark, list(wanted)))
        paths.append(staged_path)
        rows = spark.read.schema("source string, s string, p string, o string, error string").parquet(staged_path)
        own = F.col("p").isin(V.IMPORTS) & F.col("o").startswith("<")
        head = (F.col("p") == V.TYPE) & (F.col("o") == V.ONTOLOGY) & F.col("s").startswith("<")
        facts = {r["source"]: r for r in rows.groupBy("source").agg(
            F.min("error").alias("error"), F.count("s").alias("n"), F.array_sort(F.collect_set(F.when(own, F.col("o")))).alias("imports"), F.array_sort(F.collect_set(F.when(head, F.col("s")))).alias("own"),
        ).collect()}
        following: list[tuple[str, str]] = []
        for where, iris in wanted.items():
            fact = facts.get(where)
            error = fact["error"] if fact else None
            states += [Import(iri, depth, where, error, fact["n"] if fact and not error else 0) for iri in iris]
            if error and not depth:
                raise ValueError(f"{where}: {error}")
            if error:
                continue
            if not depth and fact:
                seen |= {x[1:-1] for x in fact["own"]}
            following += [(x[1:-1], where.rpartition("/")[0]) for x in (fact["imports"] if fact else [])]
        depth, wanted = depth + 1, {}
        for iri, folder in following:
            if iri in seen:
                continue
            seen.add(iri)
            if len(states) + sum(map(len, wanted.values())) >= max_imports:
                raise ValueError(f"more than {max_imports} imports")
            where = located(iri, folder)
            if where is None:
                states.append(Import(iri, depth, error="not found"))
            else:
                wanted.setdefault(where.rstrip("/"), []).append(iri)
    broken = [x.source for x in states if x.error and x.source]
    schema = "source string, s string, p string, o string, error string"
    top = spark.read.schema(schema).parquet(paths[0]).withColumn("origin", F.lit("asserted"))
    rest = [spark.read.schema(schema).parquet(*paths[1:]).filter(~F.col("source").isin(broken)).withColumn("origin", F.lit("imported"))] if paths[1:] else []
    return reduce(DataFrame.unionByName, [top, *rest]).filter("error is null").groupBy("s", "p", "o").agg(F.min("origin").alias("origin")), states


def with_origin(loaded: DataFrame, reasoned: DataFrame) -> DataFrame:
    """The result of reasoning over ``loaded`` with each triple's origin: asserted, imported or inferred."""
    return reasoned.join(loaded.select("s", "p", "o", "origin"), ["s", "p", "o"], "left").withColumn("origin", F.coalesce("origin", F.lit("inferred")))
