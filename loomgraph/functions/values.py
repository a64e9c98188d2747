"""SPARQL's value functions over term columns (``"lex"^^<datatype>``, see ``terms``): an error is null, as an unbound variable is.

Functions give terms unless they say otherwise; tests give booleans, for ``filter`` and ``condition``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions import terms
from loomgraph.vocab import XSD

# The numeric datatypes of XML Schema that derive from integer.
_INTEGERS = [f"{XSD}{n}" for n in ("integer", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")]
_EXACT = "decimal(28,8)"
_TAGGED = r'"@[A-Za-z0-9-]+$'


def _typed(value: Column, name: str) -> Column:
    return F.concat(F.lit('"'), value, F.lit(f'"^^<{XSD}{name}>'))


def plain(value: Column) -> Column:
    """A string value as a plain literal."""
    return terms.literal(value)


def boolean(value: Column) -> Column:
    return _typed(value.cast("string"), "boolean")


_XSD = XSD.replace(".", r"\.")
_EXACT_NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)"


def _number_pattern(names: str, digits: str) -> str:
    return rf'^"({digits})"\^\^<{_XSD}(?:{names})>$'


_BY_RANK = [
    _number_pattern("|".join(n.removeprefix(XSD) for n in _INTEGERS), r"[+-]?\d+"), _number_pattern("decimal", _EXACT_NUMBER),
    *(_number_pattern(n, rf"{_EXACT_NUMBER}(?:[eE][+-]?\d+)?|[+-]?INF|NaN") for n in ("float", "double")),
]
_ANY = _number_pattern("|".join(n.removeprefix(XSD) for n in _INTEGERS) + "|decimal|float|double", rf"{_EXACT_NUMBER}(?:[eE][+-]?\d+)?|[+-]?INF|NaN")


def rank(term: Column) -> Column:
    """1 integer, 2 decimal, 3 float, 4 double; null for what is no number. A term is matched as it is written, so that nested calls stay small."""
    return F.when(term.rlike(_BY_RANK[0]), 1).when(term.rlike(_BY_RANK[1]), 2).when(term.rlike(_BY_RANK[2]), 3).when(term.rlike(_BY_RANK[3]), 4)


def _digits(term: Column) -> Column:
    return F.regexp_extract(term, _ANY, 1)


def number(term: Column) -> Column:
    """The value of a number as a double."""
    return F.replace(_digits(term), F.lit("INF"), F.lit("Infinity")).try_cast("double")


def _exact(term: Column) -> Column:
    return _digits(term).try_cast(_EXACT)


def _shown(value: Column, kind: Column) -> Column:
    """A number of the kind as a term; an exact ``value`` loses the zeros at its end."""
    text = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(kind == 1, _typed(text, "integer")).when(kind == 2, _typed(text, "decimal"))


def _computed(a: Column, b: Column, op, divide: bool = False) -> Column:
    kind = F.greatest(rank(a), rank(b), *[F.lit(2)] * divide)
    exact = op(_exact(a), _exact(b)).try_cast(_EXACT)
    return F.when(rank(a).isNull() | rank(b).isNull(), F.lit(None)).when(F.greatest(rank(a), rank(b)) <= 2, _shown(exact, kind)).otherwise(F.concat(F.lit('"'), op(number(a), number(b)).cast("string"), F.when(kind == 3, f'"^^<{XSD}float>').otherwise(f'"^^<{XSD}double>')))


def add(a: Column, b: Column) -> Column:
    return _computed(a, b, F.try_add)


def subtract(a: Column, b: Column) -> Column:
    return _computed(a, b, F.try_subtract)


def multiply(a: Column, b: Column) -> Column:
    return _computed(a, b, F.try_multiply)


def divide(a: Column, b: Column) -> Column:
    """Integers give a decimal; division of exact numbers by zero is an error."""
    return _computed(a, b, F.try_divide, divide=True)


def negative(a: Column) -> Column:
    return subtract(F.lit(f'"0"^^<{XSD}integer>'), a)


# --- tests, as booleans


def is_iri(term: Column) -> Column:
    return terms.kind(term) == "iri"


def is_blank(term: Column) -> Column:
    return terms.kind(term) == "blank"


def is_literal(term: Column) -> Column:
    return terms.kind(term) == "literal"


def is_numeric(term: Column) -> Column:
    return F.when(term.isNotNull(), rank(term).isNotNull())


def same_term(a: Column, b: Column) -> Column:
    return a == b


def _is_string(term: Column) -> Column:
    return term.rlike(r'(?s)^".*"$')


def _moment(term: Column) -> Column:
    return F.regexp_extract(term, rf'^"([^"]*)"\^\^<{_XSD}dateTime>$', 1).try_cast("timestamp")


def _truth(term: Column) -> Column:
    return F.when(term.rlike(rf'^"(true|1)"\^\^<{_XSD}boolean>$'), True).when(term.rlike(rf'^"(false|0)"\^\^<{_XSD}boolean>$'), False)


def _compared(a: Column, b: Column, op, otherwise: Column) -> Column:
    return (
        F.when(number(a).isNotNull() & number(b).isNotNull(), op(number(a), number(b))).when(_is_string(a) & _is_string(b), op(terms.lex(a), terms.lex(b)))
        .when(_moment(a).isNotNull() & _moment(b).isNotNull(), op(_moment(a), _moment(b))).when(_truth(a).isNotNull() & _truth(b).isNotNull(), op(_truth(a), _truth(b))).otherwise(otherwise)
    )


def equal(a: Column, b: Column) -> Column:
    """By value for numbers, strings, moments and booleans; else by term, and null for different literals of which one has a datatype that isn't known."""
    unknown = a.startswith('"') & b.startswith('"') & (a != b) & ~a.rlike(_TAGGED) & ~b.rlike(_TAGGED)
    return _compared(a, b, lambda x, y: x == y, F.when(~unknown, a == b))


def less(a: Column, b: Column) -> Column:
    """Null for terms that have no order."""
    return _compared(a, b, lambda x, y: x < y, F.lit(None).cast("boolean"))


def one_of(term: Column, *others: Column) -> Column:
    """IN: true if any is equal; else null if any comparison is."""
    return reduce(lambda x, y: x | y, [equal(term, o) for o in others], F.lit(False))


def condition(term: Column) -> Column:
    """The effective boolean value of a term."""
    return F.when(_truth(term).isNotNull(), _truth(term)).when(rank(term).isNotNull(), (number(term) != 0) & ~F.isnan(number(term))).when(_is_string(term), terms.lex(term) != "")


def if_(test: Column, yes: Column, no: Column) -> Column:
    """Null if the test is."""
    return F.when(test, yes).when(~test, no)


def lang_matches(tag: Column, wanted: str) -> Column:
    low = F.lower(tag)
    return (low != "") if wanted == "*" else (low == wanted.lower()) | low.startswith(wanted.lower() + "-")


# --- access and building


def str_(term: Column) -> Column:
    return F.when(~is_blank(term), plain(terms.lex(term)))


def lang(term: Column) -> Column:
    return plain(terms.lang(term))


def datatype(term: Column) -> Column:
    return F.when(is_literal(term), F.concat(F.lit("<"), terms.datatype(term), F.lit(">")))


def iri(term: Column) -> Column:
    return F.when(is_iri(term), term).when(_is_string(term), F.concat(F.lit("<"), terms.lex(term), F.lit(">")))


def bnode(label: Column) -> Column:
    """A blank node for a string, the same for the same string."""
    return F.concat(F.lit("_:b"), F.sha2(terms.lex(label), 256))


def strdt(text: Column, kind: str) -> Column:
    """``kind``: the datatype's bare IRI."""
    return F.when(_is_string(text), terms.literal(terms.lex(text), kind))


def strlang(text: Column, tag: str) -> Column:
    return F.when(_is_string(text), terms.literal(terms.lex(text), lang=tag.lower()))


def uuid() -> Column:
    return F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))


def struuid() -> Column:
    return plain(F.uuid())


# --- strings


def _as(term: Column, value: Column) -> Column:
    """A string literal of the value, with the term's language if it has one; null if the term is no string."""
    return F.when(term.rlike(r'(?s)^".*"(@[A-Za-z0-9-]+)?$'), F.concat(F.lit('"'), terms.escaped(value), F.lit('"'), F.regexp_extract(term, r'"(@[A-Za-z0-9-]+)$', 1)))


def _text(term: Column) -> Column:
    return F.when(term.rlike(r'(?s)^".*"(@[A-Za-z0-9-]+)?$'), terms.lex(term))


def strlen(term: Column) -> Column:
    return _typed(F.length(_text(term)).cast("string"), "integer")


def substr(term: Column, start: int, length: int | None = None) -> Column:
    """Characters count from 1."""
    text, low = _text(term), max(start, 1)
    size = F.length(text) if length is None else F.lit(max(0, start + length - low))
    return _as(term, F.substr(text, F.lit(low), size))


def ucase(term: Column) -> Column:
    return _as(term, F.upper(terms.lex(term)))


def lcase(term: Column) -> Column:
    return _as(term, F.lower(terms.lex(term)))


def strstarts(a: Column, b: Column) -> Column:
    return F.startswith(_text(a), _text(b))


def strends(a: Column, b: Column) -> Column:
    return F.endswith(_text(a), _text(b))


def contains(a: Column, b: Column) -> Column:
    return F.contains(_text(a), _text(b))


def strbefore(a: Column, b: Column) -> Column:
    """What comes before the first place of ``b``; a plain empty string if there is none."""
    at = F.position(_text(b), _text(a))
    return F.when(at > 0, _as(a, F.substr(_text(a), F.lit(1), at - 1))).when(at == 0, plain(F.lit("")))


def strafter(a: Column, b: Column) -> Column:
    at = F.position(_text(b), _text(a))
    return F.when(at > 0, _as(a, F.substr(_text(a), at + F.length(_text(b))))).when(at == 0, plain(F.lit("")))


def encode_for_uri(term: Column) -> Column:
    text = F.replace(F.replace(F.replace(F.url_encode(_text(term)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return plain(text)


def concat(*parts: Column) -> Column:
    """One language stays if all have it."""
    tags = [terms.lang(p) for p in parts]
    one = reduce(lambda x, y: x & y, [t == tags[0] for t in tags]) & (tags[0] != "")
    text = F.concat(*[_text(p) for p in parts])
    return F.when(one, F.concat(F.lit('"'), terms.escaped(text), F.lit('"@'), tags[0])).otherwise(plain(text))


def _flagged(pattern: str, flags: str) -> str:
    return f"(?{flags})" * bool(flags) + pattern


def regex(term: Column, pattern: str, flags: str = "") -> Column:
    """Java's patterns, with the flags i, s, m and x."""
    return _text(term).rlike(_flagged(pattern, flags))


def replace(term: Column, pattern: str, to: str, flags: str = "") -> Column:
    return _as(term, F.regexp_replace(_text(term), _flagged(pattern, flags), to))


# --- numbers


def _same_kind(term: Column, exact: Callable[[Column], Column], real: Callable[[Column], Column]) -> Column:
    kind = rank(term)
    return F.when(kind <= 2, _shown(exact(_exact(term)).try_cast(_EXACT), kind)).when(kind == 3, _typed(real(number(term)).cast("string"), "float")).when(kind == 4, _typed(real(number(term)).cast("string"), "double"))


def abs_(term: Column) -> Column:
    return _same_kind(term, F.abs, F.abs)


def ceil(term: Column) -> Column:
    return _same_kind(term, F.ceil, lambda x: F.ceil(x).cast("double"))


def floor(term: Column) -> Column:
    return _same_kind(term, F.floor, lambda x: F.floor(x).cast("double"))


def round_(term: Column) -> Column:
    """Halves go up."""
    return _same_kind(term, lambda x: F.floor(x + F.lit(0.5).cast("decimal(2,1)")), lambda x: F.floor(x + 0.5).cast("double"))


def rand() -> Column:
    return terms.double(F.rand())


# --- moments: read off the lexical form, so that its zone stays


_PARTS = r"^(-?\d{4,})-(\d\d)-(\d\d)T(\d\d):(\d\d):(\d\d(?:\.\d+)?)(Z|[+-]\d\d:\d\d)?$"
_WHEN = r'^"' + _PARTS[1:-1] + rf'"\^\^<{_XSD}dateTime>$'


def _part(term: Column, k: int) -> Column:
    return F.when(term.rlike(_WHEN), F.regexp_extract(term, _WHEN, k))


def now() -> Column:
    return _typed(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), "dateTime")


def _whole(term: Column, k: int) -> Column:
    return _typed(_part(term, k).try_cast("int").cast("string"), "integer")


def year(term: Column) -> Column:
    return _whole(term, 1)


def month(term: Column) -> Column:
    return _whole(term, 2)


def day(term: Column) -> Column:
    return _whole(term, 3)


def hours(term: Column) -> Column:
    return _whole(term, 4)


def minutes(term: Column) -> Column:
    return _whole(term, 5)


def seconds(term: Column) -> Column:
    return _shown(_part(term, 6).try_cast(_EXACT), F.lit(2))


def tz(term: Column) -> Column:
    """The zone as written, empty without one."""
    return plain(_part(term, 7))


def timezone(term: Column) -> Column:
    """The zone as a dayTimeDuration; null without one."""
    zone = _part(term, 7)
    h, m = F.regexp_extract(zone, r"(\d\d):", 1).try_cast("int"), F.regexp_extract(zone, r":(\d\d)", 1).try_cast("int")
    text = F.concat(F.when(zone.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
    return _typed(F.when((zone == "Z") | ((h == 0) & (m == 0)), "PT0S").when(zone != "", text), "dayTimeDuration")


# --- hashes of a string's UTF-8 bytes


def md5(term: Column) -> Column:
    return plain(F.md5(_text(term)))


def sha1(term: Column) -> Column:
    return plain(F.sha1(_text(term)))


def sha(term: Column, bits: int) -> Column:
    """256, 384 or 512 bits."""
    return plain(F.sha2(_text(term), bits))


# --- casts


def to_string(term: Column) -> Column:
    return str_(term)


def _from(term: Column) -> Column:
    """The text of a literal that may become a number; booleans are 1 and 0."""
    return F.when(_truth(term).isNotNull(), F.when(_truth(term), "1").otherwise("0")).when(term.startswith('"'), F.trim(terms.lex(term)))


def to_boolean(term: Column) -> Column:
    return F.when(rank(term).isNotNull(), boolean((number(term) != 0) & ~F.isnan(number(term)))).when(term.rlike('^"(true|1)"'), boolean(F.lit(True))).when(term.rlike('^"(false|0)"'), boolean(F.lit(False)))


def to_integer(term: Column) -> Column:
    """Numbers lose what follows the point; other literals must be written as integers."""
    whole = F.coalesce(F.when(rank(term) == 2, _exact(term).cast("decimal(38,8)")), number(term).try_cast("decimal(38,8)")).cast("string")
    text = F.when(rank(term) > 1, F.regexp_replace(whole, r"\..*$", "")).when(_from(term).rlike(r"^[+-]?\d+$"), _from(term))
    return _typed(text.try_cast("decimal(38,0)").cast("string"), "integer")


def to_decimal(term: Column) -> Column:
    text = F.when((rank(term) > 2) | _from(term).rlike(rf"^{_EXACT_NUMBER}$"), _from(term))
    return _shown(F.coalesce(text.try_cast(_EXACT), text.try_cast("double").try_cast(_EXACT)), F.lit(2))


def to_double(term: Column) -> Column:
    return _typed(_from(term).try_cast("double").cast("string"), "double")


def to_float(term: Column) -> Column:
    return _typed(_from(term).try_cast("float").cast("string"), "float")


def to_datetime(term: Column) -> Column:
    text = terms.lex(term)
    return F.when(is_literal(term) & text.rlike(_PARTS), _typed(text, "dateTime"))


# --- order and aggregates


def order_key(term: Column) -> Column:
    """ORDER BY: unbound, blank nodes, IRIs, literals; numbers by value before other literals."""
    kind = F.when(term.isNull(), 0).when(term.startswith("_:"), 1).when(term.startswith("<"), 2).when(number(term).isNotNull(), 3).otherwise(4)
    return F.struct(kind.alias("kind"), F.coalesce(number(term), F.lit(0.0)).alias("value"), F.coalesce(terms.lex(term), F.lit("")).alias("text"), F.coalesce(term, F.lit("")).alias("term"))


def count(term: Column, distinct: bool = False) -> Column:
    """Bound values only, as a number."""
    return F.countDistinct(term) if distinct else F.count(term)


def _total(term: Column, distinct: bool, average: bool) -> Column:
    exact, real = F.when(rank(term) <= 2, _exact(term)), number(term)
    sums = F.sum_distinct if distinct else F.sum
    kind, n = F.max(rank(term)), (F.countDistinct if distinct else F.count)(term)
    bad = F.count(F.when(term.isNotNull() & rank(term).isNull(), 1)) > 0
    whole, inexact = sums(exact), sums(real)
    if average:
        whole, inexact, kind = F.try_divide(whole, n), F.try_divide(inexact, n), F.greatest(kind, F.lit(2))
    found = F.when(kind <= 2, _shown(whole.try_cast("decimal(38,8)"), kind)).when(kind == 3, _typed(inexact.cast("float").cast("string"), "float")).otherwise(_typed(inexact.cast("string"), "double"))
    return F.when(bad, F.lit(None)).when(n == 0, F.lit(f'"0"^^<{XSD}integer>')).otherwise(found)


def sum_(term: Column, distinct: bool = False) -> Column:
    """0 for no values; null if any value is no number."""
    return _total(term, distinct, False)


def avg(term: Column, distinct: bool = False) -> Column:
    return _total(term, distinct, True)


def min_(term: Column) -> Column:
    """The least bound value in the order of ORDER BY."""
    return F.min(F.when(term.isNotNull(), F.struct(order_key(term).alias("k"), term.alias("t"))))["t"]


def max_(term: Column) -> Column:
    return F.max(F.when(term.isNotNull(), F.struct(order_key(term).alias("k"), term.alias("t"))))["t"]


def sample(term: Column) -> Column:
    """Any bound value: the smallest term, so that reruns agree."""
    return F.min(term)


def group_concat(term: Column, separator: str = " ", distinct: bool = False) -> Column:
    """The texts in order, so that reruns agree; an empty string for no values."""
    gather = F.collect_set if distinct else F.collect_list
    return plain(F.array_join(F.array_sort(gather(F.when(~is_blank(term), terms.lex(term)))), separator))
