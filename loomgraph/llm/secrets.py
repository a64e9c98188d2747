"""Scan of texts for secrets, with weak candidates reported only where complementary parts of a credential stand together.

Base spans (assign, access, hex) are always reported. Weak candidates are identifiers (``user = ...``), values (``pass: ...``, bare mixed strings)
and endpoints (URLs, ``host = ...``). Each identifier, weak or an access key, claims an interval of REACH code points on both sides within
its scope, the text between two blank lines. An interval join finds the values and endpoints in it. The parts make a credential if there is an
identifier and a value, and one of them is a base span or an endpoint stands with them; then all its weak parts are reported.

Built-in functions only: a text is matched in the scan, and only matches, named by their text's digest, are dealt and joined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.shared import attach, staged

#: Fixed patterns of the base kinds, and the least length of the group that decides.
ASSIGN, ASSIGN_LEAST = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8
#: The runs of the other two are maximal, so a least length inside the pattern drops just those that fail.
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
_IS = r"""["']?\x20*[:=]\x20*["']?"""
IDENTIFIER = rf"(?i)(?:user|username|login|account|client_?id|access_?key_?id){_IS}[A-Za-z0-9@._-]{{3,}}"
VALUE = rf"(?i)(?:pass|pwd|passphrase|private_?key|access_?key|auth|credential){_IS}[A-Za-z0-9+/_.=-]{{6,}}|[A-Za-z0-9+/]{{40,}}"
ENDPOINT = rf"""(?i)(?:https?|ftp|jdbc:[a-z]+|postgresql|mysql|mongodb|redis|amqp|s3)://[^\x00-\x20"'<>]+|(?:host|hostname|server|endpoint){_IS}[A-Za-z0-9._:-]{{3,}}"""
BREAK = r"\n[\x20\t\r]*\n"
#: In the order in which spans at one place are listed; a break parts scopes and is no span.
KINDS = ("assign", "access", "hex", "identifier", "value", "endpoint", "break")
REACH = 256
_HITS = "array<struct<kind: int, i: int, gap: int, size: int, ok: boolean>>"


def _matches(text: Column, kind: int, pattern: str, group: int = 0, fits: Callable[[Column], Column] = lambda g: F.lit(True)) -> Column:
    """The matches of a pattern from left to right: how many code points lie before each since the last, its size, whether its ``group`` fits."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    if group:
        found = F.zip_with(found, F.regexp_extract_all(text, F.lit(pattern), group), lambda m, g: F.struct(F.length(m).alias("size"), fits(g).alias("ok")))
    else:
        found = F.transform(found, lambda m: F.struct(F.length(m).alias("size"), fits(m).alias("ok")))
    # the text behind the last match is one more piece
    each = F.filter(F.zip_with(found, between, lambda m, b: F.struct(F.length(b).alias("gap"), m.alias("m"))), lambda x: x["m"].isNotNull())
    each = F.transform(each, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["gap"].alias("gap"), x["m"]["size"].alias("size"), x["m"]["ok"].alias("ok")))
    return F.when(text.rlike(pattern), each.cast(_HITS)).otherwise(F.array().cast(_HITS))


def _valued(match: Column) -> Column:
    """Whether a weak value is one: it is assigned, or has 40 characters of three kinds."""
    return match.rlike("[:=]") | (F.length(match) == 40) & match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")


def hits(text: Column) -> Column:
    """All matches of a text, base kinds first; weak kinds and breaks are looked for only where an identifier and a value can meet."""
    base = F.concat(_matches(text, 0, ASSIGN, 2, lambda g: F.length(g) >= ASSIGN_LEAST), _matches(text, 1, ACCESS), _matches(text, 2, HEX))
    weak = F.concat(_matches(text, 3, IDENTIFIER), _matches(text, 4, VALUE, fits=_valued), _matches(text, 5, ENDPOINT), _matches(text, 6, BREAK))
    linked = (text.contains("AKIA") | text.rlike(IDENTIFIER)) & (text.rlike(ASSIGN) | text.rlike(HEX) | text.rlike(VALUE))
    return F.concat(base, F.when(linked, weak).otherwise(F.array().cast(_HITS)))


def located(texts: DataFrame) -> DataFrame:
    """(digest, kind, from, to, scope) of the matches of (digest, hits): code points, end exclusive. A base match that is too short is none, a weak one that
    meets a base span neither."""
    one = texts.select("digest", F.explode("hits").alias("h")).select("digest", "h.*")
    before = Window.partitionBy("digest", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = one.withColumn("to", F.sum(F.col("gap").cast("long") + F.col("size")).over(before)).withColumn("from", F.col("to") - F.col("size")).filter("ok")
    base = F.col("kind") <= 2
    order = Window.partitionBy("digest").orderBy("from", "kind")
    past, ahead = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    seen = placed.select(
        "digest", "kind", "from", "to", F.count(F.when(F.col("kind") == 6, 1)).over(past).alias("scope"),
        F.max(F.when(base, F.col("to"))).over(past).alias("ended"), F.min(F.when(base, F.col("from"))).over(ahead).alias("begins"),
    )
    met = (F.col("ended") > F.col("from")) | (F.col("begins") < F.col("to"))
    return seen.filter((F.col("kind") < 6) & (base | ~F.coalesce(met, F.lit(False)))).drop("ended", "begins")


def credentials(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(digest, kind, from): the weak parts of credentials, by an interval join of identifiers with values and endpoints on (digest, scope, cell of
    ``reach`` code points). A cell holds few matches, as they do not overlap, so an identifier meets few."""
    cell = lambda c: F.floor(c / reach)
    keys = ["digest", "scope", "cell"]
    names = found.filter(F.col("kind").isin(1, 3)).select("digest", "scope", F.col("kind").alias("k"), F.col("from").alias("f"), (F.col("from") - reach).alias("low"), (F.col("to") + reach).alias("high"))
    names = names.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    parts = found.filter(F.col("kind").isin(0, 2, 4, 5)).withColumn("cell", cell(F.col("from")))
    linked = staged(names.join(parts, keys).filter("`from` >= low and `to` <= high").select("digest", "k", "f", "kind", "from"))
    value, strong, endpoint = F.col("kind") != 5, F.col("kind").isin(0, 2) | (F.col("k") == 1), F.col("kind") == 5
    sets = linked.groupBy("digest", "k", "f").agg(F.max(value).alias("value"), F.max(value & strong | endpoint).alias("sure")).filter("value and sure").select("digest", "k", "f")
    whole = linked.join(sets, ["digest", "k", "f"])
    return whole.select("digest", F.explode(F.array(F.struct(F.col("k").alias("kind"), F.col("f").alias("from")), F.struct("kind", "from"))).alias("x")).select("digest", "x.*").filter("kind > 2").distinct()


def _listed(spans: Column) -> Column:
    label = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", label(s["kind"]), s["from"], s["to"])), ",")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans), spans (kind:start:end of all, comma-joined by start, then
    kind as in KINDS).

    Null and empty texts have no spans. Equal texts have equal spans, whatever their ids; ids may be null or repeat, each row comes out. A text that a large
    share of all rows has is linked once and looked up by ``attach``. An empty table gives no rows. Other columns are not looked at,
    whatever their names. A bare value has exactly 40 characters; a part of a longer run is none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    scanned = staged(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), hits(text).alias("hits")))
    scanned = scanned.withColumn("digest", F.when(F.size("hits") > 0, F.col("digest")))
    texts = staged(scanned.filter("digest is not null").groupBy("digest").agg(F.first("hits").alias("hits"), F.count("*").alias("n")))
    found = staged(located(texts))
    weak = credentials(found, reach).withColumn("reported", F.lit(True))
    all_ = found.join(weak, ["digest", "kind", "from"], "left").filter("kind <= 2 or reported")
    spans = F.array_sort(F.collect_list(F.struct("from", "kind", "to")))
    result = all_.groupBy("digest").agg(spans.alias("all")).withColumn("base", F.filter("all", lambda s: s["kind"] <= 2))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    result = result.select("digest", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"))
    result = staged(result.join(texts.select("digest", "n"), "digest"))
    out = attach(scanned.select("doc_id", "digest"), result, "digest", "n", "doc_id")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_assign", "n_access", "n_hex")]
    return out.select("doc_id", *zero, F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
