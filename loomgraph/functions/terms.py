"""Terms as one injective string: ``<iri>``, ``_:id``, ``"lex"``, ``"lex"@lang``, ``"lex"^^<datatype>``; all functions are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.vocab import XSD

# The datatypes that facets compare as numbers, gYear among them.
NUMERIC = [f"{XSD}{n}" for n in ("integer", "int", "long", "short", "decimal", "double", "float", "nonNegativeInteger", "positiveInteger", "gYear")]


def iri(base: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"<{base}"), *[p.cast("string") for p in parts], F.lit(">"))


def escaped(text: Column) -> Column:
    for plain, mark in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescaped(text: Column) -> Column:
    """The other way round. Escaped backslashes stand aside as U+0001 b meanwhile, and U+0001 itself as U+0001 a."""
    for mark, plain in (("\x01", "\x01a"), ("\\\\", "\x01b"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x01b", "\\"), ("\x01a", "\x01")):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def literal(value: Column, datatype: str | None = None, lang: str | None = None) -> Column:
    """A literal; xsd:string is the plain form."""
    tail = f"@{lang}" if lang else f"^^<{datatype}>" if datatype and datatype != f"{XSD}string" else ""
    return F.concat(F.lit('"'), escaped(value.cast("string")), F.lit(f'"{tail}'))


def integer(value: Column) -> Column:
    return literal(value, f"{XSD}integer")


def double(value: Column) -> Column:
    return literal(value, f"{XSD}double")


def kind(term: Column) -> Column:
    """iri, blank or literal."""
    return F.when(term.startswith("<"), "iri").when(term.startswith("_:"), "blank").when(term.startswith('"'), "literal")


def _last_quote(term: Column) -> Column:
    return F.length(term) - F.instr(F.reverse(term), '"') + 1


def _tail(term: Column) -> Column:
    """What follows the closing quote of a literal: nothing, a language tag or a datatype; neither has quotes."""
    return F.substr(term, _last_quote(term) + 1)


def lex(term: Column) -> Column:
    """The lexical form of a literal, the bare IRI, or the label of a blank node."""
    return F.when(term.startswith("<"), F.substr(term, F.lit(2), F.length(term) - 2)).when(term.startswith('"'), unescaped(F.substr(term, F.lit(2), _last_quote(term) - 2))).otherwise(F.substr(term, F.lit(3)))


def lang(term: Column) -> Column:
    """The language tag, empty for other literals and null for other terms."""
    return F.when(term.startswith('"'), F.when(_tail(term).startswith("@"), F.substr(_tail(term), F.lit(2))).otherwise(""))


def datatype(term: Column) -> Column:
    """The datatype IRI of a literal."""
    tail = _tail(term)
    found = F.when(tail.startswith("@"), F.lit("http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")).when(tail == "", F.lit(f"{XSD}string")).otherwise(F.substr(tail, F.lit(4), F.length(tail) - 4))
    return F.when(term.startswith('"'), found)


def num(term: Column) -> Column:
    """The value of a literal of a numeric datatype, else null."""
    return F.when(datatype(term).isin(NUMERIC), lex(term).try_cast("double"))


def local_name(term: Column) -> Column:
    """What follows the last ``#`` or ``/`` of an IRI; the lexical form of other terms."""
    return F.when(term.startswith("<"), F.regexp_extract(term, r"([^#/]*)>$", 1)).otherwise(lex(term))


def compat(term: Column) -> Column:
    """The prefixed output form ``i:iri``, ``b:id``, ``l:lex[@lang|^^datatype]``. It is ambiguous and for output only."""
    tail = F.when(lang(term) != "", F.concat(F.lit("@"), lang(term))).when(datatype(term) == f"{XSD}string", F.lit("")).otherwise(F.concat(F.lit("^^"), datatype(term)))
    return F.when(term.startswith("<"), F.concat(F.lit("i:"), lex(term))).when(term.startswith("_:"), F.concat(F.lit("b:"), lex(term))).otherwise(F.concat(F.lit("l:"), lex(term), tail))


def normal(term: Column) -> Column:
    """A term that was given in the output form, or as a bare IRI, in the form used here; others as they are."""
    bare = F.substr(term, F.lit(3))
    head, tail = F.regexp_extract(bare, r"(?s)^(.*?)(\^\^\S+|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?$", 1), F.regexp_extract(bare, r"(?s)^(.*?)(\^\^\S+|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?$", 2)
    typed = F.when(tail.startswith("^^"), F.concat(F.lit("^^<"), F.substr(tail, F.lit(3)), F.lit(">"))).otherwise(tail)
    return (
        F.when(term.rlike('^[<"]') | term.startswith("_:"), term).when(term.startswith("i:"), F.concat(F.lit("<"), bare, F.lit(">"))).when(term.startswith("b:"), F.concat(F.lit("_:"), bare))
        .when(term.startswith("l:"), F.concat(F.lit('"'), escaped(head), F.lit('"'), typed)).otherwise(F.concat(F.lit("<"), term, F.lit(">")))
    )
