"""Registered queries of the knowledge-graph operators over triples lifted from the given tables, with their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import vocab as V
from loomgraph.functions import terms
from loomgraph.operators import analytics, changes, expressions as X, patterns as P, rules
from loomgraph.plans.components import components
from loomgraph.plans.shared import attach, cut, shared_folder, staged, table
from loomgraph.sources.lift import Mapping, entity, lift, name, rdf_list, triples
from loomgraph.sources.ntriples import load_ntriples, write_ntriples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def key(term: Column | str) -> Column:
    """The number at an entity's end."""
    return F.regexp_extract(term, r"/(\d+)>$", 1).try_cast("long")


def col(c: str) -> Column:
    return F.col(c)


def named(kind: str, column: str) -> Callable[[], Column]:
    return lambda: entity(kind, F.col(column))


customer, supplier, nation, order, document = named("customer", "c_custkey"), named("supplier", "s_suppkey"), named("nation", "n_nationkey"), named("order", "o_orderkey"), named("document", "doc_id")


def customers(**properties: Column) -> Mapping:
    return Mapping("customer", customer(), name("Customer"), {name(k): v for k, v in properties.items()}, keyed=True)


def suppliers(**properties: Column) -> Mapping:
    return Mapping("supplier", supplier(), name("Supplier"), {name(k): v for k, v in properties.items()}, keyed=True)


def orders(**properties: Column) -> Mapping:
    return Mapping("orders", order(), name("Order"), {name(k): v for k, v in properties.items()}, keyed=True)


def nations() -> Mapping:
    return Mapping("nation", nation(), name("Nation"), {name("partOf"): entity("region", F.col("n_regionkey")), V.LABEL: terms.literal(F.col("n_name"))})


def located(prefix: str) -> Column:
    return entity("nation", F.col(f"{prefix}_nationkey"))


def placed() -> Column:
    return entity("customer", F.col("o_custkey"))


def with_schema(graph: DataFrame, *rows: tuple[str, str, str]) -> DataFrame:
    return graph.unionByName(triples(graph.sparkSession, list(rows)))


def derived(graph: DataFrame, *names: str) -> DataFrame:
    """What the named rules add."""
    return rules.infer(graph, only=set(names)).filter("level > 0")


# --- rules


@query("""select 'Agent' as cls, c_custkey as id, 1 as level from customer union all select 'Agent', s_suppkey, 1 from supplier
    union all select 'Party', c_custkey, 2 from customer union all select 'Party', s_suppkey, 2 from supplier""")
def rule_cax_sco(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = with_schema(lift(spark, sf_dir, [customers(), suppliers()]), (name("Customer"), V.SUBCLASS, name("Agent")), (name("Supplier"), V.SUBCLASS, name("Agent")), (name("Agent"), V.SUBCLASS, name("Party")))
    return derived(graph, "cax-sco").select(terms.local_name(col("o")).alias("cls"), key("s").alias("id"), "level")


@query("""with c as (select 'Customer' as a from customer union select 'Supplier' from supplier)
    select a, 'Party' as b, 1 as level from c union all select a, 'Thing0', 2 from c union all select 'Agent', 'Thing0', 1""")
def rule_scm_sco(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = lift(spark, sf_dir, [customers(), suppliers(), orders()]).filter(col("p") == V.TYPE).select("o").distinct()
    above = classes.select(col("o").alias("s"), F.lit(V.SUBCLASS).alias("p"), F.when(col("o") == name("Order"), name("Thing1")).otherwise(name("Agent")).alias("o"))
    graph = with_schema(above, (name("Agent"), V.SUBCLASS, name("Party")), (name("Party"), V.SUBCLASS, name("Thing0")))
    return derived(graph, "scm-sco").select(terms.local_name(col("s")).alias("a"), terms.local_name(col("o")).alias("b"), "level")


@query("select o_orderkey as a, o_custkey as b, 'relatedTo' as p, 1 as level from orders union all select o_orderkey, o_custkey, 'linkedTo', 2 from orders")
def rule_prp_spo1(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = with_schema(lift(spark, sf_dir, [orders(placedBy=placed())]), (name("placedBy"), V.SUBPROPERTY, name("relatedTo")), (name("relatedTo"), V.SUBPROPERTY, name("linkedTo")))
    return derived(graph, "prp-spo1").select(key("s").alias("a"), key("o").alias("b"), terms.local_name(col("p")).alias("p"), "level")


@query("select distinct 'Client' as cls, o_custkey as id from orders union all select 'Deal', o_orderkey from orders")
def rule_prp_dom_rng(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = with_schema(lift(spark, sf_dir, [orders(placedBy=placed())]), (name("placedBy"), V.DOMAIN, name("Deal")), (name("placedBy"), V.RANGE, name("Client")))
    return derived(graph, "prp-dom", "prp-rng").select(terms.local_name(col("o")).alias("cls"), key("s").alias("id"))


@query("select o_custkey as a, o_orderkey as b from orders")
def rule_prp_inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = with_schema(lift(spark, sf_dir, [orders(placedBy=placed())]), (name("placedBy"), V.INVERSE, name("placed")))
    return derived(graph, "prp-inv").select(key("s").alias("a"), key("o").alias("b"))


@query("select a.conv_id as conv, a.turn as a, b.turn as b from conversations a join conversations b on a.conv_id = b.conv_id and b.turn > a.turn where b.turn > a.turn + 1")
def rule_prp_trp(spark: SparkSession, sf_dir: str) -> DataFrame:
    here, later = (F.concat(F.lit("<http://ex.org/turn/"), col("conv_id"), F.lit("/"), col("turn") + i, F.lit(">")) for i in (0, 1))
    rows = table(spark, sf_dir, "conversations")
    graph = rows.select(here.alias("s"), F.lit(name("precedes")).alias("p"), later.alias("o")).join(rows.select(here.alias("o")), "o", "left_semi").select("s", "p", "o")
    out = derived(with_schema(graph, (name("precedes"), V.TYPE, V.TRANSITIVE)), "prp-trp")
    return out.select(F.regexp_extract("s", r"/(\d+)/\d+>$", 1).cast("long").alias("conv"), key("s").alias("a"), key("o").alias("b"))


@query("select 'Client' as cls, c_custkey as id from customer union all select 'Vendor', s_suppkey from supplier")
def rule_cax_eqc(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = with_schema(lift(spark, sf_dir, [customers(), suppliers()]), (name("Customer"), V.EQUIVALENT, name("Client")), (name("Vendor"), V.EQUIVALENT, name("Supplier")))
    return derived(graph, "cax-eqc").select(terms.local_name(col("o")).alias("cls"), key("s").alias("id"))


@query("select c_custkey as customer, n_regionkey as region from customer join nation on c_nationkey = n_nationkey")
def rule_prp_spo2(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = with_schema(lift(spark, sf_dir, [customers(locatedIn=located("c")), nations()]), (name("inRegion"), V.CHAIN, "_:chain"), *rdf_list("_:chain", [name("locatedIn"), name("partOf")]))
    return derived(graph, "prp-spo2").select(key("s").alias("customer"), key("o").alias("region"))


@query("select c_custkey as id, 'BuildingClient' as cls from customer where c_mktsegment = 'BUILDING' and c_acctbal > 0 union all select c_custkey, 'Either' from customer where c_mktsegment = 'BUILDING' or c_acctbal > 0")
def rule_cls_int_uni(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [Mapping("customer", F.when(c, customer()), name(n)) for n, c in (("Building", col("c_mktsegment") == "BUILDING"), ("Solvent", col("c_acctbal") > 0))]
    graph = with_schema(lift(spark, sf_dir, kinds), (name("BuildingClient"), V.INTERSECTION, "_:i"), *rdf_list("_:i", [name("Building"), name("Solvent")]), (name("Either"), V.UNION, "_:u"), *rdf_list("_:u", [name("Building"), name("Solvent")]))
    return derived(graph, "cls-int1", "cls-uni", "cls-int2").select(key("s").alias("id"), terms.local_name(col("o")).alias("cls"))


@query("select c_custkey as id, cls from customer, (values ('Building'), ('Solvent')) t(cls) where c_mktsegment = 'BUILDING'")
def rule_cls_int2(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = with_schema(lift(spark, sf_dir, [Mapping("customer", F.when(col("c_mktsegment") == "BUILDING", customer()), name("BuildingClient"))]), (name("BuildingClient"), V.INTERSECTION, "_:i"), *rdf_list("_:i", [name("Building"), name("Solvent")]))
    return derived(graph, "cls-int2").select(key("s").alias("id"), terms.local_name(col("o")).alias("cls"))


@query("select distinct c_custkey as id from customer join orders on o_custkey = c_custkey where o_orderpriority = '1-URGENT'")
def rule_cls_svf1(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = Mapping("orders", F.when(col("o_orderpriority") == "1-URGENT", order()), name("Urgent"))
    made = Mapping("orders", placed(), None, {name("placed"): order()})
    graph = with_schema(lift(spark, sf_dir, [urgent, made]), (name("Hasty"), V.SOME_VALUES, name("Urgent")), (name("Hasty"), V.ON_PROPERTY, name("placed")))
    return derived(graph, "cls-svf1").select(key("s").alias("id"))


@query("select distinct o_orderkey as id from customer join orders on o_custkey = c_custkey where c_mktsegment = 'BUILDING'")
def rule_cls_avf(spark: SparkSession, sf_dir: str) -> DataFrame:
    builders = Mapping("customer", F.when(col("c_mktsegment") == "BUILDING", customer()), name("OnlySite"))
    made = Mapping("orders", placed(), None, {name("placed"): order()})
    graph = with_schema(lift(spark, sf_dir, [builders, made]), (name("OnlySite"), V.ALL_VALUES, name("SiteOrder")), (name("OnlySite"), V.ON_PROPERTY, name("placed")))
    return derived(graph, "cls-avf").select(key("s").alias("id"))


@query("select doc_id as id, case when text is null then doc_id else min(doc_id) over (partition by text) end as same_as, case when text is null then 0 else count(*) over (partition by text) - 1 end as n_same from documents")
def rule_prp_key_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sameness by key over every group: each document with its class and how many others are the same, as the closure has n * n rows."""
    rows = lift(spark, sf_dir, [Mapping("documents", document(), name("Document"), {name("text"): terms.literal(F.sha2("text", 256))})])
    star = derived(with_schema(rows, (name("Document"), V.KEY, "_:k"), *rdf_list("_:k", [name("text")])), "prp-key")
    found = components(star.select(key("s").alias("a"), key("o").alias("b")))
    sizes = staged(found.groupBy("component").agg(F.count("*").alias("n")))
    known = attach(found, sizes, "component", "n", "node")
    docs = table(spark, sf_dir, "documents").select(col("doc_id").alias("id"))
    return docs.join(known, col("id") == col("node"), "left").select("id", F.coalesce("component", "id").alias("same_as"), (F.coalesce("n", F.lit(1)) - 1).alias("n_same"))


@query("select * from (select first_value(doc_id) over (partition by text order by doc_id::varchar || '>') as a, doc_id as b from documents where text is not null) where a <> b")
def rule_prp_key_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key rule over every group of equal texts, without the closure: the smallest member (as a term) to each other one."""
    rows = lift(spark, sf_dir, [Mapping("documents", document(), name("Document"), {name("text"): terms.literal(F.sha2("text", 256))})])
    out = derived(with_schema(rows, (name("Document"), V.KEY, "_:k"), *rdf_list("_:k", [name("text")])), "prp-key")
    return out.select(key("s").alias("a"), key("o").alias("b"))


@query("select doc_id as id, min(doc_id) over (partition by text) as same_as from documents")
def same_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sameness by key without its closure: each individual with the smallest one it is the same as."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    first = docs.groupBy("digest").agg(F.min("doc_id").alias("first"))
    links = docs.join(cut(first), "digest").select(col("doc_id").alias("a"), col("first").alias("b"))
    return docs.select(col("doc_id").alias("id")).join(components(links), col("id") == col("node"), "left").select("id", F.coalesce("component", "id").alias("same_as"))


@query("select o_custkey as id, o_orderkey as ord from orders join customer on o_custkey = c_custkey where c_acctbal < 0")
def rule_eq_rep_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in debt are the same as a debtor, who so placed their orders."""
    same = Mapping("customer", F.when(col("c_acctbal") < 0, customer()), None, {V.SAME: entity("debtor", col("c_custkey"))})
    made = Mapping("orders", placed(), None, {name("placed"): order()})
    out = derived(lift(spark, sf_dir, [same, made]), "eq-sym", "eq-rep-s").filter((col("p") == name("placed")) & col("s").contains("/debtor/"))
    return out.select(key("s").alias("id"), key("o").alias("ord"))


@query("""with p as (select distinct c_name, o_orderkey, o_custkey from orders join customer on o_custkey = c_custkey where c_name is not null)
    select 'account/' || sha256(c_name) as id, o_orderkey as ord from p union select 'customer/' || c.c_custkey, o_orderkey from p join customer c using (c_name) where c.c_custkey <> o_custkey""")
def rule_eq_rep_s_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is the same as the account of its name, which so placed its orders."""
    same = Mapping("customer", customer(), None, {V.SAME: entity("account", F.sha2("c_name", 256))})
    made = Mapping("orders", F.when(col("o_custkey").isNotNull(), placed()), None, {name("placed"): order()})
    out = derived(lift(spark, sf_dir, [same, made]), "eq-sym", "eq-rep-s").filter(col("p") == name("placed"))
    return out.select(F.regexp_extract("s", r"ex\.org/(.*)>$", 1).alias("id"), key("o").alias("ord"))


@query("select doc_id as id, 'cls-dj' as rule from labels where quality = 1 and toxic = 1")
def check_cls_dj(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, toxic = (Mapping("labels", F.when(col(c) == 1, document()), name(n)) for c, n in (("quality", "GoodDoc"), ("toxic", "ToxicDoc")))
    graph = with_schema(lift(spark, sf_dir, [good, toxic]), (name("GoodDoc"), V.DISJOINT, name("ToxicDoc")))
    return rules.conflicts(graph).select(key(col("conflict")[1]["s"]).alias("id"), "rule")


@query("""select 'prp-irp' as rule, c_custkey as a, c_custkey as b from customer where c_mktsegment = 'BUILDING' and c_acctbal < 0
    union all select 'prp-asyp', c_custkey, c_custkey from customer where c_mktsegment = 'BUILDING' and c_acctbal < 0
    union all select 'eq-diff1', c_custkey, c_custkey from customer where c_acctbal > 9000
    union all select 'cls-nothing2', c_custkey, null from customer where c_mktsegment = 'MACHINERY' and c_acctbal < 0""")
def check_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    here, double, balance, segment = customer(), entity("double", col("c_custkey")), col("c_acctbal"), col("c_mktsegment")
    loops, twins, none, fine = (balance < 0) & (segment == "BUILDING"), balance > 9000, (balance < 0) & (segment == "MACHINERY"), balance.between(8000, 9000)
    graph = lift(spark, sf_dir, [Mapping("customer", F.when(loops, here), None, {name("above"): here}), Mapping("customer", F.when(twins, here), None, {V.SAME: double, V.DIFFERENT: double}), Mapping("customer", F.when(none, here), V.NOTHING), Mapping("customer", F.when(fine, here), None, {name("above"): double})])
    found = rules.conflicts(with_schema(graph, (name("above"), V.TYPE, V.IRREFLEXIVE), (name("above"), V.TYPE, V.ASYMMETRIC)))
    last = F.element_at("conflict", -1)
    return found.select("rule", key(last["s"]).alias("a"), key(last["o"]).alias("b"))


@query("""with e as (select distinct o_orderkey as x, o_custkey as y from orders), d as (select doc_id, source, first_value(doc_id) over w as first, first_value(source) over w as origin from documents where text is not null window w as (partition by text order by doc_id))
    select 'prp-irp' as rule, x as a, x as b from e where x = y union all select 'prp-asyp', e.y, e.x from e join e f on f.x = e.y and f.y = e.x
    union all select 'eq-diff1', first, doc_id from d where source <> origin union all select 'cls-nothing2', doc_id, null from labels where quality = 1 and toxic = 1""")
def check_other_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers linked to customer numbers, copies of a text from two sources, good documents that are toxic."""
    node = lambda c: entity("node", col(c))
    graph = lift(spark, sf_dir, [Mapping("orders", node("o_orderkey"), None, {name("linked"): node("o_custkey")}), Mapping("labels", F.when((col("quality") == 1) & (col("toxic") == 1), document()), V.NOTHING)])
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    first = docs.groupBy("digest").agg(F.min(F.struct("doc_id", "source")).alias("first"))
    copies = docs.join(first, "digest").filter("source <> first.source").select(entity("document", col("first.doc_id")).alias("s"), F.explode(F.array(F.lit(V.SAME), F.lit(V.DIFFERENT))).alias("p"), document().alias("o"))
    found = rules.conflicts(with_schema(graph.unionByName(copies), (name("linked"), V.TYPE, V.IRREFLEXIVE), (name("linked"), V.TYPE, V.ASYMMETRIC)))
    last = F.element_at("conflict", -1)
    return found.select("rule", key(last["s"]).alias("a"), key(last["o"]).alias("b"))


@query("select c_custkey as customer, n_regionkey as region, 'Agent' as cls from customer join nation on c_nationkey = n_nationkey")
def infer_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and axioms first, customers added afterwards."""
    first = rules.infer(with_schema(lift(spark, sf_dir, [nations()]), (name("Customer"), V.SUBCLASS, name("Agent")), (name("inRegion"), V.CHAIN, "_:chain"), *rdf_list("_:chain", [name("locatedIn"), name("partOf")])))
    full = rules.infer(lift(spark, sf_dir, [customers(locatedIn=located("c"))]), start=first)
    found = P.bgp(full, [("?c", name("inRegion"), "?r"), ("?c", V.TYPE, "?t")]).filter(col("t") == name("Agent"))
    return found.select(key("c").alias("customer"), key("r").alias("region"), terms.local_name(col("t")).alias("cls"))


@query("select rule, count(*) as n from (select 'given' as rule from customer union all select 'given' from (values (1), (2)) union all select 'cax-sco' from customer union all select 'cax-sco' from customer) group by rule")
def explain_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's membership of Party, and all that it rests on."""
    graph = with_schema(lift(spark, sf_dir, [customers()]), (name("Customer"), V.SUBCLASS, name("Agent")), (name("Agent"), V.SUBCLASS, name("Party")))
    reasoned = rules.infer(graph, only={"cax-sco"})
    return rules.explain(reasoned, reasoned.filter((col("p") == V.TYPE) & (col("o") == name("Party")))).groupBy("rule").agg(F.count("*").alias("n"))


# --- graph patterns


@query("select 'Customer' as cls, count(*) as n from customer union all select 'Order', count(*) from orders union all select 'Supplier', count(*) from supplier")
def sparql_group_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scan(lift(spark, sf_dir, [customers(), orders(), suppliers()]), ("?x", V.TYPE, "?t")).groupBy(terms.local_name(col("t")).alias("cls")).agg(F.count("*").alias("n"))


@query("select o_orderkey as ord, l_quantity as quantity from orders left join (select distinct l_orderkey, l_quantity from lineitem where l_quantity > 45) on l_orderkey = o_orderkey")
def sparql_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [orders(), Mapping("lineitem", entity("order", col("l_orderkey")), None, {name("quantity"): terms.double(col("l_quantity"))})])
    items = P.scan(graph, ("?o", name("quantity"), "?q")).filter(terms.num(col("q")) > 45)
    return P.optional(P.scan(graph, ("?o", V.TYPE, name("Order"))), items).select(key("o").alias("ord"), terms.num(col("q")).alias("quantity"))


@query("select o_orderkey as ord from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def sparql_minus(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [orders(), Mapping("lineitem", entity("order", col("l_orderkey")), None, {name("item"): entity("part", col("l_partkey"))})])
    return P.minus(P.scan(graph, ("?o", V.TYPE, name("Order"))), P.scan(graph, ("?o", name("item"), "?i"))).select(key("o").alias("ord"))


@query("select c_custkey as id from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'O') and not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def sparql_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [customers(), orders(placedBy=placed(), status=terms.literal(col("o_orderstatus")))])
    having = lambda s: P.bgp(graph, [("?o", name("placedBy"), "?c"), ("?o", name("status"), f'"{s}"')])
    return P.exists(P.exists(P.scan(graph, ("?c", V.TYPE, name("Customer"))), having("O")), having("F"), negated=True).select(key("c").alias("id"))


@query("select c_custkey as id, upper(c_mktsegment) as segment, length(c_name) as n, c_acctbal + 1 as plus from customer where c_acctbal > 5000 and contains(lower(c_name), '1') ")
def sparql_filter_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [customers(balance=terms.double(col("c_acctbal")), segment=terms.literal(col("c_mktsegment")), name=terms.literal(col("c_name")))])
    found = P.bgp(graph, [("?c", name("balance"), "?b"), ("?c", name("segment"), "?s"), ("?c", name("name"), "?n")]).filter((terms.num(col("b")) > 5000) & F.lower(terms.lex(col("n"))).contains("1"))
    return found.select(key("c").alias("id"), F.upper(terms.lex(col("s"))).alias("segment"), F.length(terms.lex(col("n"))).cast("long").alias("n"), (terms.num(col("b")) + 1).alias("plus"))


@query("select o_custkey as id, count(*) as n, round(sum(o_totalprice), 2) as total, max(o_totalprice) as most from orders group by o_custkey having count(*) > 5")
def sparql_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [orders(placedBy=placed(), price=terms.double(col("o_totalprice")))])
    found = P.bgp(graph, [("?o", name("placedBy"), "?c"), ("?o", name("price"), "?p")]).withColumn("v", terms.num(col("p")))
    return found.groupBy(key("c").alias("id")).agg(F.count("*").alias("n"), F.round(F.sum("v"), 2).alias("total"), F.max("v").alias("most")).filter("n > 5")


@query("select c_custkey as id, 'customer' as what from customer where c_acctbal < 0 union all select s_suppkey, 'supplier' from supplier where s_acctbal < 0")
def sparql_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [customers(balance=terms.double(col("c_acctbal"))), suppliers(balance=terms.double(col("s_acctbal")))])
    poor = P.scan(graph, ("?x", name("balance"), "?b")).filter(terms.num(col("b")) < 0)
    return P.union(*[P.join(poor, P.scan(graph, ("?x", V.TYPE, name(c)))).select(key("x").alias("id"), F.lit(c.lower()).alias("what")) for c in ("Customer", "Supplier")])


@query("select c_custkey as id, c_mktsegment as segment, case when c_mktsegment = 'BUILDING' then 1 else 2 end as mark from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def sparql_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [customers(segment=terms.literal(col("c_mktsegment")))])
    found = P.values(P.scan(graph, ("?c", name("segment"), "?s")), [{"s": '"BUILDING"', "m": '"1"'}, {"s": '"MACHINERY"', "m": '"2"'}])
    return found.select(key("c").alias("id"), terms.lex(col("s")).alias("segment"), terms.lex(col("m")).cast("int").alias("mark"))


@query("select o_orderkey as ord, o_totalprice as price from orders order by o_totalprice desc, o_orderkey limit 25 offset 5")
def sparql_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.scan(lift(spark, sf_dir, [orders(price=terms.double(col("o_totalprice")))]), ("?o", name("price"), "?p"))
    return found.select(key("o").alias("ord"), terms.num(col("p")).alias("price")).orderBy(F.desc("price"), "ord").offset(5).limit(25)


@query("select o_orderkey as ord, n_regionkey as region from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def sparql_path_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [orders(placedBy=placed()), customers(locatedIn=located("c")), nations()])
    return P.step(graph, ("seq", name("placedBy"), name("locatedIn"), name("partOf"))).select(key("a").alias("ord"), key("b").alias("region"))


@query("select o_custkey as a, l_partkey as b from orders join (select distinct l_orderkey, l_partkey from lineitem) on l_orderkey = o_orderkey")
def sparql_path_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From customers back along placedBy to their orders, and on to the parts."""
    graph = lift(spark, sf_dir, [orders(placedBy=placed()), Mapping("lineitem", entity("order", col("l_orderkey")), None, {name("item"): entity("part", col("l_partkey"))})])
    return P.step(graph, ("seq", ("inv", name("placedBy")), name("item"))).select(key("a").alias("a"), key("b").alias("b"))


@query("select c_custkey as a, c_nationkey as nation, n from customer join (select s_nationkey, count(*) as n from supplier group by s_nationkey) on s_nationkey = c_nationkey")
def sparql_path_inverse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to the suppliers of their nation: the pairs grow with customers times suppliers, so the nation stands for its suppliers, with their number."""
    graph = lift(spark, sf_dir, [customers(livesIn=located("c")), suppliers(sitsIn=located("s"))])
    there = P.step(graph, ("inv", name("sitsIn"))).groupBy(col("a").alias("m")).agg(F.count("*").alias("n"))
    found = P.step(graph, name("livesIn")).join(there, col("b") == col("m"))
    return found.select(key("a").alias("a"), key("b").cast("int").alias("nation"), "n")


@query("select a.conv_id as conv, a.turn as a, b.turn as b from conversations a join conversations b on a.conv_id = b.conv_id and b.turn > a.turn")
def sparql_path_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    here, later = (F.concat(F.lit("<http://ex.org/turn/"), col("conv_id"), F.lit("/"), col("turn") + i, F.lit(">")) for i in (0, 1))
    rows = table(spark, sf_dir, "conversations")
    graph = rows.select(here.alias("s"), F.lit(name("next")).alias("p"), later.alias("o")).join(rows.select(here.alias("o")), "o", "left_semi").select("s", "p", "o")
    return P.step(graph, ("plus", name("next"))).select(F.regexp_extract("a", r"/(\d+)/\d+>$", 1).cast("long").alias("conv"), key("a").alias("a"), key("b").alias("b"))


@query("select distinct o_custkey as a, o_orderkey as b from orders where o_orderstatus = 'P'")
def sparql_construct(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [orders(placedBy=placed(), status=terms.literal(col("o_orderstatus")))])
    made = P.construct(P.bgp(graph, [("?o", name("status"), '"P"'), ("?o", name("placedBy"), "?c")]), [("?c", name("waitsFor"), "?o")])
    return made.select(key("s").alias("a"), key("o").alias("b"))


@query("select count(*) > 0 as answer from customer where c_mktsegment = 'BUILDING'")
def sparql_ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.ask(P.scan(lift(spark, sf_dir, [customers(segment=terms.literal(col("c_mktsegment")))]), ("?c", name("segment"), '"BUILDING"')))


@query("select c_custkey as id, p, v from customer, lateral (values ('type', 'Customer'), ('segment', c_mktsegment)) t(p, v) where c_acctbal < 0")
def sparql_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [customers(segment=terms.literal(col("c_mktsegment")), balance=terms.double(F.when(col("c_acctbal") < 0, col("c_acctbal"))))])
    poor = P.scan(graph, ("?s", name("balance"), "?b"))
    return P.describe(graph.filter(col("p") != name("balance")), poor).select(key("s").alias("id"), terms.local_name(col("p")).alias("p"), terms.local_name(col("o")).alias("v"))


# --- class expressions


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = Mapping("orders", F.when(col("o_orderpriority") == "1-URGENT", order()), name("Urgent"))
    return lift(spark, sf_dir, [customers(balance=terms.double(col("c_acctbal")), likes=F.when(col("c_mktsegment") == "HOUSEHOLD", customer())), orders(), urgent, Mapping("orders", placed(), None, {name("placed"): order()})])


def found(expression: X.Expression, graph: DataFrame) -> DataFrame:
    return expression.find(graph).select(terms.lex(col("x")).alias("x"))


def _x(kind: str, what: str) -> str:
    return f"select distinct 'http://ex.org/{kind}/' || {what} as x"


@query(f"{_x('customer', 'o_custkey')} from orders where o_orderpriority = '1-URGENT'")
def dl_some(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(X.Some(name("placed"), X.Named(name("Urgent"))), trade(spark, sf_dir))


@query(f"{_x('customer', 'c_custkey')} from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def dl_and_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(X.Named(name("Customer")) & X.Only(name("placed"), ~X.Named(name("Urgent"))), trade(spark, sf_dir))


@query(f"{_x('customer', 'o_custkey')} from orders group by o_custkey having count(*) >= 8")
def dl_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(X.Min(name("placed"), n=8), trade(spark, sf_dir))


@query(f"{_x('customer', 'c_custkey')} from customer where (select count(*) from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT') <= 1")
def dl_and_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(X.Named(name("Customer")) & X.Max(name("placed"), X.Named(name("Urgent")), n=1), trade(spark, sf_dir))


@query(f"{_x('customer', 'c_custkey')} from customer where (select count(*) from orders where o_custkey = c_custkey) = 10")
def dl_and_exactly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(X.Named(name("Customer")) & X.Exactly(name("placed"), n=10), trade(spark, sf_dir))


@query(f"{_x('order', 'o_orderkey')} from orders where o_orderpriority <> '1-URGENT'")
def dl_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(X.Named(name("Order")) & ~X.Named(name("Urgent")), trade(spark, sf_dir))


@query(f"{_x('customer', 'c_custkey')} from customer where c_mktsegment = 'HOUSEHOLD' union select 'http://ex.org/customer/1' union select 'http://ex.org/customer/2'")
def dl_self_or_one_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(X.Self(name("likes")) | X.OneOf((name("customer/1"), name("customer/2"))), trade(spark, sf_dir))


@query(f"{_x('order', 'o_orderkey')} from orders join customer on o_custkey = c_custkey where c_acctbal >= 9000 and c_acctbal < 9500")
def dl_inverse_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = X.Some(name("balance"), X.Data(f"{V.XSD}double", ((">=", 9000), ("<", 9500))))
    return found(X.Some(name("placed"), rich, inverse=True), trade(spark, sf_dir))


@query(f"{_x('order', 'o_orderkey')} from orders where o_custkey = 7")
def dl_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(X.Value(name("placed"), inverse=True, value=name("customer/7")), trade(spark, sf_dir))


# --- analytics

def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and customers, with declarations; customers in debt have no place, and those of one segment no label."""
    people = Mapping("customer", customer(), name("Customer"), {name("locatedIn"): F.when(col("c_acctbal") >= 0, located("c")), V.LABEL: F.when(col("c_mktsegment") != "BUILDING", terms.literal(col("c_name")))})
    declared = Mapping("customer", customer(), V.INDIVIDUAL)
    return with_schema(lift(spark, sf_dir, [people, declared, nations()]), *[(name(c), V.TYPE, V.CLASS) for c in ("Customer", "Nation", "Ghost")], *[(name(p), V.TYPE, V.OBJECT_PROPERTY) for p in ("locatedIn", "partOf")], (name("Customer"), V.SUBCLASS, name("Agent")))


@query("""select (select 2 * count(*) + sum((c_acctbal >= 0)::int) + sum((c_mktsegment <> 'BUILDING')::int) from customer) + (select 3 * count(*) from nation) + 6 as triples,
    3 as classes, 2 as object_properties, 0 as data_properties, (select count(*) from customer) as individuals""")
def entity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.entity_stats(catalogue(spark, sf_dir))


@query("""select 'http://ex.org/customer/' || c_custkey as x from customer where c_acctbal < 0 and c_mktsegment = 'BUILDING'
    union all select 'http://ex.org/' || n from (values ('Nation'), ('Ghost'), ('locatedIn'), ('partOf')) t(n)
    union all select 'http://www.w3.org/2002/07/owl#' || n from (values ('Class'), ('ObjectProperty'), ('NamedIndividual')) t(n)""")
def isolated_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.isolated(catalogue(spark, sf_dir)).select(terms.lex(col("x")).alias("x"))


@query("select 'http://ex.org/customer/' || c_custkey as x from customer where c_mktsegment = 'BUILDING'")
def missing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.missing_labels(catalogue(spark, sf_dir)).filter(col("x").contains("/customer/")).select(terms.lex(col("x")).alias("x"))


@query("select 'Ghost' as cls where (select count(*) from nation) > 0")
def empty_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.empty_classes(catalogue(spark, sf_dir)).select(terms.local_name(col("x")).alias("cls"))


@query("select 'Customer' as cls, count(*) as n from customer union all select 'NamedIndividual', count(*) from customer union all select 'Nation', count(*) from nation")
def individuals_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.individuals_by_type(catalogue(spark, sf_dir)).groupBy(terms.local_name(col("cls")).alias("cls")).agg(F.count("*").alias("n"))


@query("select distinct p_brand as child, substr(p_brand, 1, 7) as parent from part where p_brand <> substr(p_brand, 1, 7) union select distinct substr(p_brand, 1, 7), 'Part' from part")
def hierarchy_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands below their first seven letters, and those below Part; the closure's direct edges are reduced away."""
    kinds = table(spark, sf_dir, "part").select("p_brand", F.substring("p_brand", 1, 7).alias("w")).distinct()
    node = lambda c: F.concat(F.lit("<k:"), c, F.lit(">"))
    edge = lambda a, b: kinds.select(node(a).alias("s"), F.lit(V.SUBCLASS).alias("p"), node(b).alias("o"))
    graph = edge(col("p_brand"), col("w")).union(edge(col("w"), F.lit("Part"))).union(edge(col("p_brand"), F.lit("Part"))).distinct()
    out = lambda c: F.regexp_extract(c, "^<k:(.*)>$", 1)
    return analytics.reduced_hierarchy(graph).select(out("child").alias("child"), out("parent").alias("parent"))


@query("""with a as (select o_orderkey, o_custkey from orders), h1 as (select o_orderkey as id from a where o_custkey = 1), h2 as (select 1 as id)
    select 'customer/1' as x, 0 as depth union all select 'order/' || o_orderkey, 1 from orders where o_custkey = 1 and o_orderstatus = 'O' union all
    select 'status/O', 2 where exists (select 1 from orders where o_custkey = 1 and o_orderstatus = 'O') union all
    select 'order/' || o_orderkey, 3 from orders where o_orderstatus = 'O' and o_custkey <> 1 and exists (select 1 from orders where o_custkey = 1 and o_orderstatus = 'O')""")
def k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = col("o_orderstatus") == "O"
    graph = lift(spark, sf_dir, [Mapping("orders", F.when(open_, order()), None, {name("placedBy"): placed(), name("status"): entity("status", col("o_orderstatus"))})])
    roots = graph.sparkSession.range(1).select(F.lit(name("customer/1")).alias("x"))
    return analytics.neighbourhood(graph, roots, 3).select(F.regexp_extract("x", r"ex\.org/(.*)>$", 1).alias("x"), "depth")


@query("""select least(o_custkey, o_orderkey) as a, greatest(o_custkey, o_orderkey) as b, count(*) as n from (
    select o_orderkey, o_custkey from orders union all select o_custkey, o_orderkey from orders where o_orderstatus = 'O') group by all""")
def edge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda c: F.concat(F.lit("<n:"), F.lpad(col(c).cast("string"), 12, "0"), F.lit(">"))
    rows = table(spark, sf_dir, "orders")
    graph = rows.select(node("o_orderkey").alias("s"), F.lit(name("by")).alias("p"), node("o_custkey").alias("o")).union(rows.filter("o_orderstatus = 'O'").select(node("o_custkey"), F.lit(name("has")), node("o_orderkey")))
    number = lambda c: F.regexp_extract(c, r":(\d+)>", 1).cast("long").alias(c)
    return analytics.edge_groups(graph).select(number("a"), number("b"), "n")


@query("select 'http://ex.org/customer/' || c_custkey as x from customer where c_mktsegment <> 'BUILDING' and contains(lower(c_name), '12')")
def label_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = catalogue(spark, sf_dir)
    return analytics.label_index(graph).filter(col("x").contains("/customer/") & col("labels").contains("12")).select(terms.lex(col("x")).alias("x"))


@query("""select kind, count(*) as n from (select 'Individual' as kind from customer union all select 'Individual' from nation union all select 'Class' from (values (1), (2), (3), (4), (5), (6), (7)) t union all
    select 'ObjectProperty' from (values (1), (2), (3), (4), (5)) t union all select 'Unknown' from (select distinct n_regionkey from nation)) group by kind""")
def entity_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.entity_kinds(catalogue(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"))


# --- changes and files


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(col("value") >= 30, "add").otherwise("remove")
    return table(spark, sf_dir, "events").select(col("event_id").alias("seq"), F.floor(col("event_id") / 100).alias("batch"), kind.alias("op"), entity("user", col("user_id")).alias("s"), F.lit(name("did")).alias("p"), terms.literal(col("event_type")).alias("o"))


@query("""select user_id as s, event_type as o from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as k from events where event_id // 100 <= (select max(event_id) // 100 // 2 from events)) where k = 1 and value >= 30""")
def change_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as it was at the middle of the log."""
    log = changelog(spark, sf_dir)
    middle = (log.agg(F.max("batch")).first()[0] or 0) // 2
    return changes.replay(log.limit(0), log, until_batch=middle).select(key("s").alias("s"), terms.lex(col("o")).alias("o"))


@query("select user_id as s, event_type as o from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as k from events) where k = 1 and value >= 30")
def change_replay_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changelog(spark, sf_dir)
    return changes.replay(log.limit(0), log).select(key("s").alias("s"), terms.lex(col("o")).alias("o"))


@query("""with l as (select * from events), last as (select max(event_id // 100) as m from events),
    cur as (select user_id as s, event_type as o from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as k from l) where k = 1 and value >= 30),
    b as (select user_id as s, event_type as o, (value < 30)::int as odd from (select *, row_number() over (partition by user_id, event_type order by event_id) as k from l, last where event_id // 100 > m - 3) where k = 1)
    select s, o from cur where not exists (select 1 from b where b.s = cur.s and b.o = cur.o) union select s, o from b where odd = 1""")
def change_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changelog(spark, sf_dir)
    return changes.undo(changes.replay(log.limit(0), log), log, 3).select(key("s").alias("s"), terms.lex(col("o")).alias("o"))


@query("select op, count(*) as n from (select 'add' as op from orders where o_orderstatus = 'O' union all select 'remove' from orders where o_orderstatus = 'F') group by op")
def source_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda gone: lift(spark, sf_dir, [Mapping("orders", F.when(col("o_orderstatus") != gone, order()), name("Order"))])
    return changes.difference(side("O"), side("F")).groupBy("op").agg(F.count("*").alias("n"))


@query("select o_orderkey as ord, case when o_custkey = 7 then 999999999 else o_custkey end as customer from orders")
def iri_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [Mapping("orders", order(), None, {name("placedBy"): placed()})])
    return changes.rename(graph, name("customer/7"), name("customer/999999999")).select(key("s").alias("ord"), key("o").alias("customer"))


@query("select doc_id as id, lang, text from documents")
def ntriples_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as literals, written as N-Triples files and read again."""
    path = f"{shared_folder(spark)}/loomgraph-nt-{uuid.uuid4().hex}"
    write_ntriples(lift(spark, sf_dir, [Mapping("documents", document(), None, {name("text"): terms.literal(col("text")), name("lang"): terms.literal(col("lang"))})]), path)
    graph = load_ntriples(spark, path)
    return P.bgp(graph, [("?d", name("text"), "?t"), ("?d", name("lang"), "?l")]).select(key("d").alias("id"), terms.lex(col("l")).alias("lang"), terms.lex(col("t")).alias("text"))
