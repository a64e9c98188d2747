"""Statistics, data-quality checks, hierarchies and neighbourhoods over triples (s, p, o)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph import vocab as V
from loomgraph.functions import terms
from loomgraph.operators.patterns import closure
from loomgraph.plans.layout import small_tasks
from loomgraph.plans.shared import MERGED_ROWS, attach, cut, staged


def _typed(cls: str) -> Column:
    return (F.col("p") == V.TYPE) & (F.col("o") == cls)


def entity_stats(triples: DataFrame) -> DataFrame:
    """One row: triples, and subjects declared as each kind of entity."""
    kinds = {"classes": V.CLASS, "object_properties": V.OBJECT_PROPERTY, "data_properties": V.DATA_PROPERTY, "individuals": V.INDIVIDUAL}
    return triples.agg(F.count("*").alias("triples"), *[F.count(F.when(_typed(c), 1)).alias(n) for n, c in kinds.items()])


def _ends(triples: DataFrame) -> DataFrame:
    """(x, typed): the IRIs at both ends of each triple, and whether it is a typing."""
    ends = triples.select(F.explode(F.array("s", "o")).alias("x"), (F.col("p") == V.TYPE).alias("typed")).filter(F.col("x").startswith("<"))
    return ends.groupBy("x").agg(F.min("typed").alias("only_typed"))


def isolated(triples: DataFrame) -> DataFrame:
    """IRIs that occur in typings only."""
    return _ends(triples).filter("only_typed").select("x")


def missing_labels(triples: DataFrame) -> DataFrame:
    """IRIs at the ends of triples without a label; predicates don't count."""
    return _ends(triples).select("x").join(triples.filter(F.col("p") == V.LABEL).select(F.col("s").alias("x")), "x", "left_anti")


def empty_classes(triples: DataFrame) -> DataFrame:
    """IRIs declared as classes without a member."""
    declared = triples.filter(_typed(V.CLASS) & F.col("s").startswith("<")).select(F.col("s").alias("x")).distinct()
    return declared.join(triples.filter(F.col("p") == V.TYPE).select(F.col("o").alias("x")), "x", "left_anti")


def reduced_hierarchy(triples: DataFrame, predicate: str = V.SUBCLASS) -> DataFrame:
    """(child, parent): the predicate's edges but loops and those that one step in between makes redundant, unless the step and
    the parent are below each other."""
    edges = triples.filter((F.col("p") == predicate) & (F.col("s") != F.col("o"))).select(F.col("s").alias("child"), F.col("o").alias("parent")).distinct()
    up = edges.select(F.col("child").alias("mid"), "parent")
    mutual = up.join(up.select(F.col("parent").alias("mid"), F.col("mid").alias("parent")), ["mid", "parent"], "left_semi")
    one_way = up.join(mutual, ["mid", "parent"], "left_anti")
    redundant = edges.select("child", F.col("parent").alias("mid")).join(one_way, "mid").select("child", "parent")
    return edges.join(redundant, ["child", "parent"], "left_anti")


def property_hierarchy(triples: DataFrame, kind: str = V.OBJECT_PROPERTY) -> DataFrame:
    """The reduced hierarchy of properties, with both ends declared as the kind."""
    declared = triples.filter(_typed(kind)).select("s").distinct()
    edges = triples.filter(F.col("p") == V.SUBPROPERTY).join(declared, "s", "left_semi").join(declared.select(F.col("s").alias("o")), "o", "left_semi")
    return reduced_hierarchy(edges.select("s", "p", "o"), V.SUBPROPERTY)


def hierarchy_roots(triples: DataFrame, nodes: DataFrame, predicate: str = V.SUBCLASS) -> DataFrame:
    """Roots of the reduced hierarchy over ``nodes`` (x): those without a parent, and of each cycle that no root reaches the smallest node."""
    edges = cut(reduced_hierarchy(triples, predicate))
    every = cut(nodes.select("x").union(edges.select("child")).union(edges.select("parent")).distinct())
    roots = every.join(edges.select(F.col("child").alias("x")), "x", "left_anti")
    below = cut(closure(edges.select(F.col("parent").alias("a"), F.col("child").alias("b"))))
    lost = every.join(roots, "x", "left_anti").join(below.join(roots.withColumnRenamed("x", "a"), "a", "left_semi").select(F.col("b").alias("x")), "x", "left_anti")
    reach = below.join(lost.select(F.col("x").alias("a")), "a", "left_semi").join(lost.select(F.col("x").alias("b")), "b", "left_semi")
    beaten = reach.join(reach.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti").select(F.col("b").alias("x"))  # reached by one that they don't reach
    inner = reach.filter("a < b").join(reach.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_semi").select(F.col("b").alias("x"))
    return roots.unionByName(lost.join(beaten.unionByName(inner), "x", "left_anti")).distinct()


def visible(triples: DataFrame, text: str, predicate: str = V.SUBCLASS) -> DataFrame:
    """Nodes of a hierarchy that match a text, or have something below them that does."""
    edges = triples.filter(F.col("p") == predicate)
    nodes = edges.select(F.col("s").alias("x")).union(edges.select(F.col("o").alias("x"))).distinct()
    hit = cut(nodes.join(search(triples, text), "x", "left_semi"))
    above = closure(edges.select(F.col("s").alias("a"), F.col("o").alias("b"))).join(hit.withColumnRenamed("x", "a"), "a", "left_semi")
    return hit.union(above.select("b")).distinct()


def individuals_by_type(triples: DataFrame) -> DataFrame:
    """(cls, member): subjects that are no schema entities, by each of their types; a row for each, as a class may have any number."""
    types = triples.filter(F.col("p") == V.TYPE)
    meta = types.filter(F.col("o").isin(V.META)).select("s")
    return types.filter(~F.col("o").isin(V.META)).join(meta, "s", "left_anti").select(F.col("o").alias("cls"), F.col("s").alias("member")).distinct()


def filtered_individuals(triples: DataFrame, text: str) -> DataFrame:
    """(cls, n): the members whose name or label has the text, by type."""
    hit = search(triples, text).select(F.col("x").alias("member"))
    return individuals_by_type(triples).join(hit, "member", "left_semi").groupBy("cls").agg(F.count("*").alias("n"))


def individual_counts(triples: DataFrame) -> DataFrame:
    """(cls, n) as above without the members."""
    types = triples.filter(F.col("p") == V.TYPE)
    meta = types.filter(F.col("o").isin(V.META)).select("s").distinct()
    return types.filter(~F.col("o").isin(V.META)).join(meta, "s", "left_anti").groupBy(F.col("o").alias("cls")).agg(F.countDistinct("s").alias("n"))


def label_index(triples: DataFrame) -> DataFrame:
    """(x, labels): lower-case labels of each entity, sorted, one a line."""
    return triples.filter(F.col("p") == V.LABEL).groupBy(F.col("s").alias("x")).agg(F.array_join(F.array_sort(F.collect_list(F.lower(terms.lex(F.col("o"))))), "\n").alias("labels"))


def display_label(term: Column) -> Column:
    """What a term is shown as: an IRI's last part, a literal in quotes, a blank node as it is."""
    return F.when(term.startswith('"'), F.concat(F.lit('"'), terms.lex(term), F.lit('"'))).when(term.startswith("_:"), term).otherwise(terms.local_name(term))


def search(triples: DataFrame, text: str) -> DataFrame:
    """Entities whose IRI or any label has the text, whatever the case."""
    wanted = text.lower()
    named = triples.select(F.explode(F.array("s", "o")).alias("x")).filter(F.lower("x").contains(wanted) & ~F.col("x").startswith('"'))
    labelled = triples.filter((F.col("p") == V.LABEL) & F.lower(terms.lex(F.col("o"))).contains(wanted)).select(F.col("s").alias("x"))
    return named.unionByName(labelled).distinct()


def neighbourhood(triples: DataFrame, roots: DataFrame, depth: int, limit: int | None = None, hub: int | None = None) -> DataFrame:
    """(x, depth): what the roots (x) reach in so many steps along triples in both directions, by the fewest steps.

    ``limit``: so many nodes at most beside the roots, nearer ones first, then by name. ``hub``: nodes with more links than this are
    reached but not gone on from.
    """
    with small_tasks(triples.sparkSession):
        return _neighbourhood(triples, roots, depth, limit, hub)


def _neighbourhood(triples: DataFrame, roots: DataFrame, depth: int, limit: int | None, hub: int | None) -> DataFrame:
    links = triples.select(F.explode(F.array(F.struct(F.col("s").alias("a"), F.col("o").alias("x")), F.struct(F.col("o").alias("a"), F.col("s").alias("x")))).alias("e")).select("e.a", "e.x").distinct()
    links = staged(links)
    hubs = None if hub is None else cut(links.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > hub).select("a"))
    found = fresh = cut(roots.select("x", F.lit(0).alias("depth")).distinct())
    for d in range(1, depth + 1):
        ends = fresh.select(F.col("x").alias("a"))
        near = _near(links, ends if hubs is None or d == 1 else ends.join(hubs, "a", "left_anti"), fresh.count()).select("x").distinct()
        fresh = near.join(found, "x", "left_anti").withColumn("depth", F.lit(d))
        if limit is not None:
            fresh = fresh.orderBy("x").limit(max(0, limit - found.filter("depth > 0").count()))
        fresh = cut(fresh)
        found = found.unionByName(fresh)
    return found


def _near(links: DataFrame, ends: DataFrame, n: int) -> DataFrame:
    """The ``links`` (a, x) from ``ends`` (a), each there once and at most ``n``. No task gets all links of a node: few ends are broadcast, of many those with the most links."""
    if n <= MERGED_ROWS:
        return links.join(F.broadcast(ends), "a", "left_semi")
    counted = staged(links.groupBy("a").agg(F.count("*").alias("n")).join(ends.hint("merge"), "a", "left_semi").withColumn("met", F.lit(True)))
    return attach(links, counted, "a", "n", "x").filter("met").select("a", "x")


def induced(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """The triples with both ends among ``nodes`` (x)."""
    return triples.join(nodes.select(F.col("x").alias("s")), "s", "left_semi").join(nodes.select(F.col("x").alias("o")), "o", "left_semi").select(*triples.columns)


def edge_groups(triples: DataFrame) -> DataFrame:
    """(a, b, n): triples by the unordered pair of their ends."""
    return triples.groupBy(F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b")).agg(F.count("*").alias("n"))


def edge_sample(reasoned: DataFrame, limit: int = 500) -> DataFrame:
    """Up to ``limit`` triples, given ones before inferred ones."""
    return reasoned.orderBy((F.col("level") > 0), "s", "p", "o").limit(limit)


def node_types(triples: DataFrame) -> DataFrame:
    """(x, node_type) of every end of a triple: Property, else Class, Literal, Blank or Individual."""
    kinds = [
        triples.filter(_typed(V.CLASS) | _typed(V.rdfs("Class"))).select(F.col("s").alias("x"), F.lit(1).alias("k")), *[triples.filter(F.col("p") == V.SUBCLASS).select(F.col(c).alias("x"), F.lit(1).alias("k")) for c in "so"],
        triples.filter(_typed(V.OBJECT_PROPERTY) | _typed(V.DATA_PROPERTY)).select(F.col("s").alias("x"), F.lit(2).alias("k")), *[triples.filter(F.col("p") == V.SUBPROPERTY).select(F.col(c).alias("x"), F.lit(2).alias("k")) for c in "so"],
    ]
    ends = [triples.select(F.col(c).alias("x"), F.lit(0).alias("k")) for c in "so"]
    known = reduce(DataFrame.unionByName, ends + kinds).groupBy("x").agg(F.max("k").alias("k"))
    what = F.when(F.col("x").startswith('"'), "Literal").when(F.col("x").startswith("_:"), "Blank").when(F.col("k") == 2, "Property").when(F.col("k") == 1, "Class").otherwise("Individual")
    return known.select("x", what.alias("node_type"))


def entity_kinds(triples: DataFrame) -> DataFrame:
    """(x, kind) of every IRI: by its declarations, else by its use."""
    flag = lambda c: F.max(F.coalesce(c, F.lit(False)))
    is_type = F.col("p") == V.TYPE
    rows = [
        triples.select(F.col("s").alias("x"), F.when(is_type, F.col("o")).alias("t"), (F.col("p") == V.SUBCLASS).alias("as_class"), F.lit(False).alias("as_property")),
        triples.select(F.col("o").alias("x"), F.lit(None).cast("string").alias("t"), (is_type | (F.col("p") == V.SUBCLASS)).alias("as_class"), F.lit(False).alias("as_property")),
        triples.select(F.col("p").alias("x"), F.lit(None).cast("string").alias("t"), F.lit(False).alias("as_class"), F.lit(True).alias("as_property")),
    ]
    # The characteristics of properties.
    characteristics = [V.owl(n) for n in ("FunctionalProperty", "InverseFunctionalProperty", "TransitiveProperty", "SymmetricProperty", "AsymmetricProperty", "ReflexiveProperty", "IrreflexiveProperty")]
    declared = {"class": [V.CLASS, V.rdfs("Class"), V.owl("Restriction")], "object": [V.OBJECT_PROPERTY], "special": characteristics, "data": [V.DATA_PROPERTY], "annotation": [V.ANNOTATION_PROPERTY], "datatype": [V.rdfs("Datatype")], "property": [V.rdf("Property")]}
    seen = reduce(DataFrame.unionByName, rows).filter(F.col("x").startswith("<")).groupBy("x").agg(
        *[flag(F.col("t").isin(v)).alias(k) for k, v in declared.items()], flag(F.col("as_class")).alias("as_class"), flag(F.col("as_property")).alias("as_property"), F.count("t").alias("types")
    )
    c = F.col
    kind = F.when(c("class"), "Class").when(c("object") | (c("special") & ~c("data")), "ObjectProperty").when(c("data"), "DataProperty").when(c("annotation"), "AnnotationProperty").when(c("datatype"), "Datatype").when(c("property"), "ObjectProperty")
    return seen.select("x", kind.when(c("as_class"), "Class").when(c("as_property"), "ObjectProperty").when(c("types") > 0, "Individual").otherwise("Unknown").alias("kind"))


def relations(reasoned: DataFrame, entity: str) -> DataFrame:
    """(direction, p, other, level) of an entity's triples."""
    out = reasoned.filter(F.col("s") == entity).select(F.lit("out").alias("direction"), "p", F.col("o").alias("other"), "level")
    return out.unionByName(reasoned.filter(F.col("o") == entity).select(F.lit("in").alias("direction"), "p", F.col("s").alias("other"), "level"))


def inferred_above(reasoned: DataFrame, entity: str) -> DataFrame:
    """(p, o): an entity's inferred types and superclasses, without itself and blank nodes."""
    return reasoned.filter((F.col("s") == entity) & (F.col("level") > 0) & F.col("p").isin(V.TYPE, V.SUBCLASS) & (F.col("o") != entity) & ~F.col("o").startswith("_:")).select("p", "o")


def axioms(triples: DataFrame, entity: str, predicate: str, symmetric: bool = False, limit: int = 200) -> DataFrame:
    """(x): the objects of an entity's axioms of one predicate, in order; with ``symmetric`` also the subjects that point at it. Among types those of
    the OWL vocabulary are left out."""
    out = triples.filter((F.col("s") == entity) & (F.col("p") == predicate)).select(F.col("o").alias("x"))
    if symmetric:
        out = out.unionByName(triples.filter((F.col("o") == entity) & (F.col("p") == predicate)).select(F.col("s").alias("x")))
    if predicate == V.TYPE:
        out = out.filter(~F.col("x").startswith(f"<{V.OWL}"))
    return out.distinct().orderBy("x").limit(limit)


def source_preview(triples: DataFrame, lines: int = 500, large: int = 50_000) -> DataFrame:
    """(line): the graph as N-Triples in order; of a large one the first lines only."""
    shown = triples.select(F.concat_ws(" ", "s", "p", "o", F.lit(".")).alias("line")).orderBy("line")
    return shown.limit(lines) if triples.limit(large + 1).count() > large else shown


# The annotation properties in common use.
COMMON_ANNOTATIONS = (
    V.LABEL, V.rdfs("comment"), V.rdfs("seeAlso"), V.rdfs("isDefinedBy"), V.owl("versionInfo"),
    *(f"<http://www.w3.org/2004/02/skos/core#{n}>" for n in ("prefLabel", "altLabel", "definition")), "<http://purl.org/dc/terms/source>", "<http://purl.org/dc/terms/date>",
)


def annotations(triples: DataFrame, common: tuple[str, ...] = COMMON_ANNOTATIONS) -> DataFrame:
    """Triples of the common and the declared annotation properties."""
    declared = triples.filter(_typed(V.ANNOTATION_PROPERTY)).select(F.col("s").alias("p")).distinct()
    return triples.filter(F.col("p").isin(list(common))).unionByName(triples.join(declared, "p", "left_semi").filter(~F.col("p").isin(list(common))).select("s", "p", "o"))


def without_system(triples: DataFrame) -> DataFrame:
    """Triples whose predicate is not of the RDF, RDFS or OWL vocabulary."""
    return triples.filter(~F.col("p").rlike("^<(" + "|".join(x.replace(".", r"\.") for x in (V.RDF, V.RDFS, V.OWL)) + ")"))


def origin_counts(reasoned: DataFrame) -> DataFrame:
    """(origin, n): asserted, imported and inferred triples; without a column ``origin`` all given ones are asserted."""
    origin = F.col("origin") if "origin" in reasoned.columns else F.when(F.col("level") > 0, "inferred").otherwise("asserted")
    return reasoned.groupBy(origin.alias("origin")).agg(F.count("*").alias("n"))


def paged(df: DataFrame, order: list[str], page: int, size: int = 200) -> DataFrame:
    """One page of an ordered listing."""
    return df.orderBy(*order).offset(page * size).limit(size)
