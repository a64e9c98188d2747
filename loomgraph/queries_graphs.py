"""Registered queries of files, explanations, edits, analytics and further rules, with their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import vocab as V
from loomgraph.functions import terms
from loomgraph.operators import analytics, changes, editing, expressions, rules
from loomgraph.operators import patterns as P
from loomgraph.plans.shared import shared_folder, table
from loomgraph.queries import catalogue, changelog, col, customer, customers, derived, key, located, name, nation, nations, order, orders, placed, query, suppliers, with_schema
from loomgraph.sources import rdf
from loomgraph.sources.lift import Mapping, entity, lift, triples
from loomgraph.sources.ntriples import load_ntriples, write_ntriples


def _path(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/loomgraph-{uuid.uuid4().hex}/{kind}"


@query("select o_orderkey as a, o_custkey as b from orders")
def rule_eq_rep_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = with_schema(lift(spark, sf_dir, [orders(placedBy=placed())]), (name("placedBy"), V.SAME, name("orderedBy")))
    return derived(graph, "eq-rep-p").filter(col("p") == name("orderedBy")).select(key("s").alias("a"), key("o").alias("b"))


@query("select o_orderkey as ord, c_custkey as debtor from orders join customer on o_custkey = c_custkey where c_acctbal < 0")
def rule_eq_rep_o(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = Mapping("customer", F.when(col("c_acctbal") < 0, customer()), None, {V.SAME: entity("debtor", col("c_custkey"))})
    out = derived(lift(spark, sf_dir, [same, orders(placedBy=placed())]), "eq-rep-o").filter((col("p") == name("placedBy")) & col("o").contains("/debtor/"))
    return out.select(key("s").alias("ord"), key("o").alias("debtor"))


@query("select 'order/' || o_orderkey as a, 'order' as b, 1 as level from orders union all select 'order/' || o_orderkey, 'thing', 1 from orders where o_orderstatus = 'O' union all select 'order/' || o_orderkey, 'thing', 2 from orders where o_orderstatus <> 'O'")
def rule_scm_spo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property for each order, below one for its status; properties of open orders have a shorter way up."""
    own, status = entity("order", col("o_orderkey")), entity("status", col("o_orderstatus"))
    graph = lift(spark, sf_dir, [Mapping("orders", own, None, {V.SUBPROPERTY: status}, keyed=True), Mapping("orders", status, None, {V.SUBPROPERTY: F.lit(name("order"))})])
    graph = graph.unionByName(lift(spark, sf_dir, [Mapping("orders", F.when(col("o_orderstatus") == "O", status), None, {V.SUBPROPERTY: F.lit(name("thing"))})]))
    out = derived(with_schema(graph, (name("order"), V.SUBPROPERTY, name("thing"))), "scm-spo").filter(col("s").contains("/order/"))
    return out.select(F.regexp_extract("s", r"ex\.org/(.*)>$", 1).alias("a"), terms.local_name(col("o")).alias("b"), "level")


@query("select 'customer' as kind, count(*) as n from customer union all select 'nation', count(distinct c_nationkey) from customer union all select 'p', 1 from (select 1) where exists (select 1 from customer)")
def rule_eq_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [Mapping("customer", customer(), None, {name("p"): located("c")}, keyed=True)])
    kind = F.regexp_extract("s", r"ex\.org/([a-z]+)", 1)
    return rules.eq_ref(graph).filter(col("s") == col("o")).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("select s_suppkey as id, s_nationkey as nation, s_acctbal as balance from supplier")
def turtle_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "suppliers.ttl")
    rdf.write_turtle(lift(spark, sf_dir, [suppliers(sitsIn=located("s"), balance=terms.double(col("s_acctbal")))]), path, {"ex": "http://ex.org/"})
    found = P.bgp(rdf.read_rdf(spark, path), [("?x", name("sitsIn"), "?n"), ("?x", name("balance"), "?b")])
    return found.select(key("x").alias("id"), key("n").cast("int").alias("nation"), terms.num(col("b")).alias("balance"))


@query("select doc_id as id, lang, text from documents where text is not null and not regexp_matches(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')")
def rdfxml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as literals; those with characters that XML forbids can't be written."""
    path, fit = _path(spark, "documents.rdf"), ~col("text").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
    subject = F.when(fit, entity("document", col("doc_id")))
    rdf.write_rdfxml(lift(spark, sf_dir, [Mapping("documents", subject, None, {name("text"): terms.literal(col("text")), name("lang"): terms.literal(col("lang"))})]), path)
    found = P.bgp(rdf.read_rdf(spark, path), [("?d", name("text"), "?t"), ("?d", name("lang"), "?l")])
    return found.select(key("d").alias("id"), terms.lex(col("l")).alias("lang"), terms.lex(col("t")).alias("text"))


@query("select origin, count(*) as n from (select 'asserted' as origin from supplier, range(2) union all select 'asserted' from range(2) union all select 'imported' from nation, range(3) union all select 'inferred' from supplier) group by origin")
def imports_and_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers import a file of nations, which imports the suppliers again; reasoning adds a class. Triples by origin."""
    top = _path(spark, "")
    own = with_schema(lift(spark, sf_dir, [suppliers(sitsIn=located("s"))]), (name("graph"), V.TYPE, V.ONTOLOGY), (name("graph"), V.IMPORTS, name("nations")))
    rdf.write_turtle(own, f"{top}graph.ttl")
    rdf.write_turtle(with_schema(lift(spark, sf_dir, [nations()]), (name("graph"), V.IMPORTS, name("nations"))), f"{top}nations.ttl")
    loaded, states = rdf.load(spark, f"{top}graph.ttl")
    assert [(s.iri, s.error) for s in states] == [("http://ex.org/nations", None)]
    reasoned = rdf.with_origin(loaded, rules.infer(with_schema(loaded.select("s", "p", "o"), (name("Supplier"), V.SUBCLASS, name("Agent")))))
    return analytics.origin_counts(reasoned.filter(col("p") != V.SUBCLASS))


@query("select o_orderkey as ord, o_custkey as customer, o_totalprice as price from orders")
def turtle_blank_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is reached through a blank node of its placing; the graph is written in eight files, which part most nodes' triples."""
    path = _path(spark, "placings.ttl")
    rdf.write_turtle(placings(spark, sf_dir), path, {"ex": "http://ex.org/"}, parts=8)
    return placed_through(rdf.read_rdf(spark, path))


@query("select o_orderkey as ord, o_custkey as customer, o_totalprice as price from orders")
def rdfxml_blank_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "placings.rdf")
    rdf.write_rdfxml(placings(spark, sf_dir), path, parts=8)
    return placed_through(rdf.read_rdf(spark, path))


@query("select o_orderkey as ord, o_custkey as customer, o_totalprice as price from orders union all select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'P'")
def ntriples_blank_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two graphs with the same labels, the second of pending orders only: their nodes stay apart when both are read at once."""
    top = _path(spark, "")
    for graph, states in (("all", ("O", "F", "P")), ("pending", ("P",))):
        write_ntriples(placings(spark, sf_dir, states), f"{top}{graph}.nt")
    return placed_through(load_ntriples(spark, [f"{top}all.nt", f"{top}pending.nt"]))


def placings(spark: SparkSession, sf_dir: str, states: tuple[str, ...] = ("O", "F", "P")) -> DataFrame:
    node = F.when(col("o_orderstatus").isin(*states), F.concat(F.lit("_:o"), col("o_orderkey")))
    made = Mapping("orders", F.when(col("o_orderstatus").isin(*states), placed()), None, {name("made"): node})
    return lift(spark, sf_dir, [made, Mapping("orders", node, None, {name("of"): order(), name("price"): terms.double(col("o_totalprice"))})])


def placed_through(graph: DataFrame) -> DataFrame:
    found = P.bgp(graph, [("?c", name("made"), "?m"), ("?m", name("of"), "?o"), ("?m", name("price"), "?p")])
    return found.select(key("o").alias("ord"), key("c").alias("customer"), terms.num(col("p")).alias("price"))


@query("select s_suppkey as id, n_regionkey as region, 'imported' as origin from supplier join nation on s_nationkey = n_nationkey")
def imports_by_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file imports one for each region, which import one for each of their nations, with its suppliers: three levels, three reads."""
    nation_rows, supplier_rows = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    file = lambda kind, c: F.concat(F.lit(kind), col(c))
    line = lambda s, p, o: F.concat_ws(" ", s, F.lit(p), o, F.lit("."))
    iri = lambda kind, c: F.concat(F.lit("<http://ex.org/f="), file(kind, c), F.lit(">"))
    parts = [
        nation_rows.select(F.lit("top").alias("f"), line(F.lit(name("top")), V.IMPORTS, iri("r", "n_regionkey")).alias("value")),
        nation_rows.select(file("r", "n_regionkey").alias("f"), line(F.lit(name("regions")), V.IMPORTS, iri("n", "n_nationkey")).alias("value")),
        nation_rows.select(file("r", "n_regionkey").alias("f"), line(nation(), name("partOf"), entity("region", col("n_regionkey"))).alias("value")),
        supplier_rows.select(file("n", "s_nationkey").alias("f"), line(entity("supplier", col("s_suppkey")), name("sitsIn"), located("s")).alias("value")),
    ]
    top = _path(spark, "files")
    reduce(DataFrame.unionByName, parts).filter("value is not null and f is not null").distinct().repartition("f").write.partitionBy("f").text(top)
    loaded, _ = rdf.load(spark, f"{top}/f=top")
    sits, part = (P.scan(loaded, pattern, {"origin": "origin"} if i == 0 else None) for i, pattern in enumerate([("?s", name("sitsIn"), "?n"), ("?n", name("partOf"), "?r")]))
    return P.join(sits, part).select(key("s").alias("id"), key("r").cast("int").alias("region"), "origin")


@query("select 'http://ex.org/customer/' || c_custkey as c, c_name || ' of ' || c_mktsegment as n from customer")
def tsv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file's lines under the names that its head gives; tabs inside of values are spaces."""
    path = _path(spark, "customers")
    graph = lift(spark, sf_dir, [Mapping("customer", customer(), None, {V.LABEL: terms.literal(F.concat(col("c_name"), F.lit("\tof\n"), col("c_mktsegment")))})])
    rdf.write_tsv(P.scan(graph, ("?c", V.LABEL, "?n")).select("c", "n"), path)
    return rdf.read_tsv(spark, path)


@query("select c_custkey as id, 'type' as p, 'Customer' as o from customer where c_acctbal > 9000 union all select null, 'subClassOf', 'Agent' where exists (select 1 from customer where c_acctbal > 9000) union all select null, 'subClassOf', 'Party' where exists (select 1 from customer where c_acctbal > 9000)")
def explain_justification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given triples on which the membership in Party of rich customers rests."""
    rich = Mapping("customer", F.when(col("c_acctbal") > 9000, customer()), name("Customer"))
    graph = with_schema(lift(spark, sf_dir, [rich]), (name("Customer"), V.SUBCLASS, name("Agent")), (name("Agent"), V.SUBCLASS, name("Party")))
    reasoned = rules.infer(graph, only={"cax-sco"})
    found = rules.justification(rules.explain(reasoned, reasoned.filter((col("p") == V.TYPE) & (col("o") == name("Party")))))
    return found.select(key("s").alias("id"), terms.local_name(col("p")).alias("p"), terms.local_name(col("o")).alias("o"))


@query("select user_id as s, event_type as o from (select *, row_number() over (partition by user_id, event_type order by event_id // 100 desc, (value >= 30)::int desc, event_id desc) as k from events) where k = 1 and value >= 30")
def change_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log with each batch's removals before its additions."""
    log = changelog(spark, sf_dir)
    return changes.replay(log.limit(0), log, removes_first=True).select(key("s").alias("s"), terms.lex(col("o")).alias("o"))


@query("""with m as (select max(event_id // 100) as m from events), c as (select event_id, user_id as s, event_type as o, value, event_id // 100 as b from events),
    cur as (select s, o from (select *, row_number() over (partition by s, o order by event_id desc) as k from c) where k = 1 and value >= 30),
    un as (select s, o, value from (select *, row_number() over (partition by s, o order by event_id) as k from c, m where b > m - 3) where k = 1),
    back as (select * from cur where (s, o) not in (select (s, o) from un) union select s, o from un where value < 30),
    re as (select s, o, value from (select *, row_number() over (partition by s, o order by event_id desc) as k from c, m where b = m - 2) where k = 1)
    select * from back where (s, o) not in (select (s, o) from re) union select s, o from re where value >= 30""")
def change_redo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches undone and the first of them done again."""
    log = changelog(spark, sf_dir)
    undone = changes.undo(changes.replay(log.limit(0), log), log, 3)
    return changes.redo(undone, log, 3).select(key("s").alias("s"), terms.lex(col("o")).alias("o"))


@query("select o_orderkey as ord from orders where o_custkey <> 7")
def entity_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [Mapping("orders", order(), None, {name("placedBy"): placed()}, keyed=True)])
    return changes.delete_entity(graph, name("customer/7")).select(key("s").alias("ord"))


@query("select n_nationkey as id, case when n_nationkey = 3 then 'Renamed' else n_name end as label from nation")
def label_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.relabel(lift(spark, sf_dir, [nations()]), name("nation/3"), "Renamed").filter(col("p") == V.LABEL).select(key("s").alias("id"), terms.lex(col("o")).alias("label"))


@query("select node_type, count(*) as n from (select 'Individual' as node_type from customer union all select 'Individual' from (select distinct c_nationkey from customer) union all select 'Literal' from (select distinct c_mktsegment from customer) union all select 'Individual' from range(1)) group by node_type")
def node_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [customers(locatedIn=located("c"), segment=terms.literal(col("c_mktsegment")))])
    return analytics.node_types(graph).groupBy("node_type").agg(F.count("*").alias("n"))


@query("select c_custkey as id from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)")
def induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links between customers and the nations of a region."""
    graph = lift(spark, sf_dir, [customers(locatedIn=located("c")), nations()])
    there = P.scan(graph, ("?x", name("partOf"), name("region/1"))).unionByName(P.scan(graph, ("?x", V.TYPE, name("Customer"))))
    return analytics.induced(analytics.without_system(graph), there).select(key("s").alias("id"))


@query("select o_orderkey as other from orders where o_custkey = 7 order by o_orderkey limit 5 offset 5")
def relations_paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of what points at an entity."""
    reasoned = rules.infer(lift(spark, sf_dir, [orders(placedBy=placed())]), only=set())
    found = analytics.relations(reasoned, name("customer/7")).filter("direction = 'in'").select(key("other").alias("other"))
    return analytics.paged(found, ["other"], 1, 5)


@query("select 'Customer' as cls, count(*) as n from customer where c_mktsegment <> 'BUILDING' and contains(lower(c_name), '12') or contains('http://ex.org/customer/' || c_custkey, '12') union all select 'NamedIndividual', count(*) from customer where c_mktsegment <> 'BUILDING' and contains(lower(c_name), '12') or contains('http://ex.org/customer/' || c_custkey, '12') union all select 'Nation', count(*) from nation where contains(lower(n_name), '12') or contains(n_nationkey::varchar, '12')")
def individuals_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.filtered_individuals(catalogue(spark, sf_dir), "12").select(terms.local_name(col("cls")).alias("cls"), "n")


@query("select c_custkey as id from customer where c_acctbal > 9000 order by 'http://ex.org/customer/' || c_custkey")
def dl_sorted_thing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All individuals, in the order of their names."""
    graph = lift(spark, sf_dir, [Mapping("customer", F.when(col("c_acctbal") > 9000, customer()), name("Rich"))])
    return expressions.instances(expressions.Named(V.THING), graph).select(key("x").alias("id"))


@query("select distinct 'super' as relation, 'Agent' as x from customer union all select distinct 'sub', c_mktsegment from customer union all select 'equivalent', 'Client'")
def dl_related_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = lift(spark, sf_dir, [Mapping("customer", F.concat(F.lit("<http://ex.org/"), col("c_mktsegment"), F.lit(">")), None, {V.SUBCLASS: F.lit(name("Customer"))})])
    graph = with_schema(segments, (name("Customer"), V.SUBCLASS, name("Agent")), (name("Client"), V.EQUIVALENT, name("Customer")))
    return expressions.related_classes(graph, [name("Customer")]).select("relation", terms.local_name(col("x")).alias("x"))


@query("select count(*) as n from orders where o_custkey = 7")
def axiom_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A restriction with a part for each order of a customer is removed with all its parts but no other."""
    node = F.concat(F.lit("_:r"), col("o_custkey"))
    parts = lift(spark, sf_dir, [Mapping("orders", node, None, {name("part"): F.concat(F.lit("_:o"), col("o_orderkey"))}), Mapping("orders", F.concat(F.lit("_:o"), col("o_orderkey")), None, {name("is"): order()})])
    whole = parts.unionByName(triples(spark, [(name("C"), V.SUBCLASS, "_:r7")]))
    return editing.axiom_removal(whole, (name("C"), V.SUBCLASS, "_:r7")).filter(col("p") == name("is")).agg(F.count("*").alias("n"))
