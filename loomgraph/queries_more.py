"""Registered queries of sameness by representatives, unbound variables, paths from bound ends, label index, pages, explanations, views and scheduling, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import vocab as V
from loomgraph.functions import terms
from loomgraph.operators import analytics, changes, paging, rules, sameness, search
from loomgraph.operators import patterns as P
from loomgraph.queries import changelog, col, customer, customers, document, entity, key, located, name, nations, order, orders, placed, query, suppliers, with_schema
from loomgraph.plans.shared import cut, table
from loomgraph.sources import rdf
from loomgraph.sources.lift import Mapping, lift, rdf_list


# --- sameness by representatives

_SAME = "case when text is null then doc_id else first_value(doc_id) over (partition by text order by doc_id::varchar || '>') end"


@query(f"""with s as (select doc_id, source, {_SAME} as same_as from documents)
    select doc_id as id, same_as, n_sources from s join (select same_as, count(distinct source) as n_sources from s group by same_as) using (same_as)""")
def sameness_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one text are the same; each representative has the sources of all its group, and only the asked rows are expanded to the members."""
    rows = lift(spark, sf_dir, [Mapping("documents", document(), name("Document"), {name("text"): terms.literal(F.sha2("text", 256)), name("source"): terms.literal(col("source"))})])
    merged = sameness.infer_merged(with_schema(rows, (name("Document"), V.KEY, "_:k"), *rdf_list("_:k", [name("text")])), only={"prp-key"})
    found = P.scan(merged.triples, ("?d", V.TYPE, name("Document"))).select("d", F.col("d").alias("same_as"))
    sources = P.scan(merged.triples, ("?d", name("source"), "?s")).groupBy("d").agg(F.countDistinct("s").alias("n_sources"))
    whole = merged.expand(found.join(sources, "d", "left"), ["d"])
    return whole.select(key("d").alias("id"), key("same_as").alias("same_as"), F.coalesce("n_sources", F.lit(0).cast("long")).alias("n_sources"))


@query("""with p as (select distinct c_name, o_orderkey, o_custkey from orders join customer on o_custkey = c_custkey where c_name is not null)
    select 'account/' || sha256(c_name) as id, o_orderkey as ord from p union select 'customer/' || c.c_custkey, o_orderkey from p join customer c using (c_name)""")
def sameness_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who placed each order: the customer, the account of its name and the other customers with that name, from one row for each group."""
    same = Mapping("customer", customer(), None, {V.SAME: entity("account", F.sha2("c_name", 256))})
    made = Mapping("orders", F.when(col("o_custkey").isNotNull(), placed()), None, {name("placed"): order()})
    merged = sameness.infer_merged(lift(spark, sf_dir, [same, made]))
    found = merged.expand(P.scan(merged.triples, ("?c", name("placed"), "?o")), ["c"])
    return found.select(F.regexp_extract("c", r"ex\.org/(.*)>$", 1).alias("id"), key("o").alias("ord"))


# --- unbound variables

_SIDES = """with l as (select c_custkey as id, case when c_acctbal >= 0 then c_nationkey end as n, case when c_mktsegment <> 'BUILDING' then floor(c_acctbal / 1000)::int end as k from customer),
    r as (select distinct case when s_acctbal >= 0 then s_nationkey end as n, case when s_acctbal < 5000 then floor(s_acctbal / 1000)::int end as k from supplier),
    m as (select l.id, l.n as ln, l.k as lk, r.n, r.k from l join r on (l.n is null or r.n is null or l.n = r.n) and (l.k is null or r.k is null or l.k = r.k)) """


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and kinds of suppliers by nation and thousands of their balance, each of which some lack."""
    thousands = lambda c: terms.integer(F.floor(col(c) / 1000))
    left = lift(spark, sf_dir, [customers(in_=F.when(col("c_acctbal") >= 0, located("c")), has=F.when(col("c_mktsegment") != "BUILDING", thousands("c_acctbal")))])
    right = lift(spark, sf_dir, [suppliers(in_=F.when(col("s_acctbal") >= 0, located("s")), has=F.when(col("s_acctbal") < 5000, thousands("s_acctbal")))])
    both = []
    for graph, kind in ((left, "Customer"), (right, "Supplier")):
        found = P.optional(P.scan(graph, ("?x", V.TYPE, name(kind))), P.scan(graph, ("?x", name("in_"), "?n")))
        both.append(P.optional(found, P.scan(graph, ("?x", name("has"), "?k"))))
    return both[0], both[1].select("n", "k").distinct()


@query(_SIDES + "select id from l where id not in (select id from m where (ln is not null and n is not null) or (lk is not null and k is not null))")
def sparql_minus_unbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.minus(*_sides(spark, sf_dir)).select(key("x").alias("id"))


@query(_SIDES + "select id, exists (select 1 from m where m.id = l.id and (n is null or n > 2)) as met from l")
def sparql_exists_unbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _sides(spark, sf_dir)
    some = right.filter(F.coalesce(key("n") > 2, F.lit(True)))
    return P.exists(left, some).select(key("x").alias("id"), F.lit(True).alias("met")).unionByName(P.exists(left, some, negated=True).select(key("x").alias("id"), F.lit(False).alias("met")))


@query(_SIDES + "select id, coalesce(ln, n)::bigint as nation, coalesce(lk, k)::bigint as thousands from m where n < 5 union all select id, n, k from l where id not in (select id from m where n < 5)")
def sparql_optional_unbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partners by the nation and the thousands that both have; what one lacks the other fills in."""
    left, right = _sides(spark, sf_dir)
    found = P.optional(left, right.withColumn("low", F.coalesce(key("n") < 5, F.lit(False))), F.col("low"))
    return found.select(key("x").alias("id"), key("n").alias("nation"), terms.num(col("k")).cast("long").alias("thousands"))


@query("select o_custkey as id, count(*) as n from orders group by o_custkey")
def sparql_construct_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node without a name for each order of a customer."""
    made = P.construct(P.scan(lift(spark, sf_dir, [orders(placedBy=placed())]), ("?o", name("placedBy"), "?c")), [("?c", name("waits"), "_:w"), ("_:w", name("for"), "?o")])
    return P.bgp(made, [("?c", name("waits"), "?w"), ("?w", name("for"), "?o")]).groupBy(key("c").alias("id")).agg(F.countDistinct("w").alias("n"))


# --- paths from bound ends


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    here, later = (F.concat(F.lit("<http://ex.org/turn/"), col("conv_id"), F.lit("/"), col("turn") + i, F.lit(">")) for i in (0, 1))
    rows = table(spark, sf_dir, "conversations")
    return rows.select(here.alias("s"), F.lit(name("next")).alias("p"), later.alias("o")).join(rows.select(here.alias("o")), "o", "left_semi").select("s", "p", "o")


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.regexp_extract("a", r"/(\d+)/\d+>$", 1).cast("long").alias("conv"), key("a").alias("a"), key("b").alias("b"))


@query("select a.conv_id as conv, a.turn as a, b.turn as b from conversations a join conversations b on a.conv_id = b.conv_id and b.turn >= a.turn where a.turn = 0")
def sparql_path_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that follows each conversation's first turn, searched from there."""
    starts = table(spark, sf_dir, "conversations").filter("turn = 0").select(F.concat(F.lit("<http://ex.org/turn/"), col("conv_id"), F.lit("/0>")).alias("a"))
    return _pairs(P.paths_from(_turns(spark, sf_dir), ("star", name("next")), starts))


@query("with l as (select conv_id, max(turn) as last from conversations group by conv_id) select conv_id as conv, turn as a, last as b from conversations join l using (conv_id) where turn < last")
def sparql_path_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that leads to each conversation's last turn, searched back from it."""
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    ends = last.select(F.concat(F.lit("<http://ex.org/turn/"), col("conv_id"), F.lit("/"), col("turn"), F.lit(">")).alias("b"))
    return _pairs(P.paths_to(_turns(spark, sf_dir), ("plus", name("next")), ends))


# --- search, pages, views


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift(spark, sf_dir, [Mapping("part", entity("part", col("p_partkey")), name("Part"), {V.LABEL: terms.literal(F.concat_ws(" ", "p_type", "p_name")), name("note"): terms.literal(col("p_brand")), name("size"): terms.integer(col("p_size"))}, keyed=True)])


@query("select p_partkey as id from part where contains(lower(concat_ws(' ', p_type, p_name)), 'y red') or contains(lower(concat_ws(' ', p_type, p_name)), 'gear')")
def label_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two searches in lists of three characters."""
    index = search.label_index(_parts(spark, sf_dir))
    return index.search("Y RED").unionByName(index.search("gear")).distinct().select(key("x").alias("id"))


@query("select o_orderkey as ord, o_orderpriority as priority from orders order by o_orderpriority, o_orderkey limit 200 offset (select count(*) // 400 * 200 from orders)")
def relations_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page in the middle of all orders by priority and number."""
    graph = lift(spark, sf_dir, [orders(priority=terms.literal(col("o_orderpriority")))])
    found = P.scan(graph, ("?o", name("priority"), "?p")).select(key("o").alias("ord"), terms.lex(col("p")).alias("priority"))
    listing = paging.pages(found, ["priority", "ord"], size=200)
    return listing.page(listing.rows // 400)


@query("select p_partkey as id, 'label' as p, concat_ws(' ', p_type, p_name) as v from part union all select p_partkey, 'note', p_brand from part")
def annotations_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.annotations(with_schema(_parts(spark, sf_dir), (name("note"), V.TYPE, V.ANNOTATION_PROPERTY)))
    return found.select(key("s").alias("id"), terms.local_name(col("p")).alias("p"), terms.lex(col("o")).alias("v"))


@query("select distinct split_part(p_type, ' ', 1) as above from part")
def inferred_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of parts are below their first words; the catalogue below each type."""
    kind = lambda c: F.concat(F.lit("<k:"), F.translate(c, " ", "_"), F.lit(">"))
    rows = table(spark, sf_dir, "part").select("p_type").distinct()
    graph = rows.select(F.lit(name("catalogue")).alias("s"), F.lit(V.SUBCLASS).alias("p"), kind(F.concat(col("p_type"), F.lit(" parts"))).alias("o"))
    graph = graph.unionByName(rows.select(kind(F.concat(col("p_type"), F.lit(" parts"))).alias("s"), F.lit(V.SUBCLASS).alias("p"), kind(F.split("p_type", " ")[0]).alias("o")))
    return analytics.inferred_above(rules.infer(graph, only={"scm-sco"}), name("catalogue")).select(F.regexp_extract("o", "^<k:(.*)>$", 1).alias("above"))


@query("select distinct p_brand as child, substr(p_brand, 1, 7) as parent from part where p_brand <> substr(p_brand, 1, 7)")
def property_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as properties below their first letters, and those below an undeclared one; the direct edge to the top is no edge."""
    node = lambda c: F.concat(F.lit("<k:"), c, F.lit(">"))
    rows = table(spark, sf_dir, "part").select(col("p_brand").alias("a"), F.substring("p_brand", 1, 7).alias("b")).distinct()
    edges = rows.select(node(col("a")).alias("s"), F.lit(V.SUBPROPERTY).alias("p"), node(col("b")).alias("o")).unionByName(rows.select(node(col("b")).alias("s"), F.lit(V.SUBPROPERTY).alias("p"), F.lit(name("made")).alias("o")))
    declared = rows.select(F.explode(F.array("a", "b")).alias("x")).distinct().select(node(col("x")).alias("s"), F.lit(V.TYPE).alias("p"), F.lit(V.OBJECT_PROPERTY).alias("o"))
    plain = lambda c: F.regexp_extract(c, "^<k:(.*)>$", 1)
    return analytics.property_hierarchy(edges.distinct().unionByName(declared)).select(plain("child").alias("child"), plain("parent").alias("parent"))


@query("""with g as (select null::bigint as id, 'subClassOf' as p, '<http://ex.org/Customer>' as k union all select c_custkey, 'type', '<http://ex.org/customer/' || c_custkey || '>' from customer)
    select id, p, 0 as level from g order by k limit 500""")
def edge_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 triples, given ones first."""
    reasoned = rules.infer(with_schema(lift(spark, sf_dir, [customers()]), (name("Customer"), V.SUBCLASS, name("Agent"))), only={"cax-sco"})
    return analytics.edge_sample(reasoned).select(key("s").alias("id"), terms.local_name(col("p")).alias("p"), "level")


@query("select distinct 'source/' || source as x from documents where source is not null union select distinct 'lang/' || lang from documents where lang is not null")
def axiom_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is equivalent to a class, from both sides."""
    forth = Mapping("documents", F.lit(name("Document")), None, {V.EQUIVALENT: entity("source", col("source"))})
    back = Mapping("documents", entity("lang", col("lang")), None, {V.EQUIVALENT: F.lit(name("Document"))})
    found = analytics.axioms(lift(spark, sf_dir, [forth, back]), name("Document"), V.EQUIVALENT, symmetric=True)
    return found.select(F.regexp_extract("x", r"ex\.org/(.*)>$", 1).alias("x"))


@query("""with l as (select distinct '<http://ex.org/order/' || l_orderkey || '> <http://ex.org/item> <http://ex.org/part/' || l_partkey || '> .' as line from lineitem)
    select line from l order by line limit (select case when count(*) > 50000 then 500 else count(*) end from l)""")
def source_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.source_preview(lift(spark, sf_dir, [Mapping("lineitem", entity("order", col("l_orderkey")), None, {name("item"): entity("part", col("l_partkey"))})]))


@query("select n_nationkey as id, n_nationkey::varchar as shown, '\"' || n_name || '\"' as label from nation")
def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.scan(lift(spark, sf_dir, [nations()]), ("?n", V.LABEL, "?l")).select(key("n").cast("int").alias("id"), analytics.display_label(col("n")).alias("shown"), analytics.display_label(col("l")).alias("label"))


@query("""with roots as (select c_custkey as c, c_nationkey as n from customer where c_acctbal < -900),
    near as (select distinct 'nation/' || n as x from roots union select 'order/' || o_orderkey from orders where o_custkey in (select c from roots))
    select 'customer/' || c as x, 0 as depth from roots union all select * from (select x, 1 as depth from near order by '<http://ex.org/' || x || '>' limit 60)""")
def k_hop_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around customers in deep debt: nations, which have too many links to go on from, and orders; 60 at most."""
    graph = lift(spark, sf_dir, [Mapping("customer", customer(), None, {name("locatedIn"): located("c")}), Mapping("orders", order(), None, {name("placedBy"): placed()})])
    roots = table(spark, sf_dir, "customer").filter("c_acctbal < -900").select(customer().alias("x"))
    return analytics.neighbourhood(graph, roots, 3, limit=60, hub=40).select(F.regexp_extract("x", r"ex\.org/(.*)>$", 1).alias("x"), "depth")


# --- explanations, scheduling, export


@query("select 'customer/' || c_custkey || ' order/' || o_orderkey as way from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey where n_nationkey = 0 and o_orderstatus = 'P'")
def chain_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From a nation by its customers and their orders to a status."""
    chain = [Mapping("customer", located("c"), None, {name("home"): customer()}), Mapping("orders", placed(), None, {name("placed"): order()}), Mapping("orders", order(), None, {name("is"): entity("status", col("o_orderstatus"))})]
    found = rules.chain_path(lift(spark, sf_dir, chain), [name("home"), name("placed"), name("is")], name("nation/0"), name("status/P"))
    return found.select(F.array_join(F.transform(F.slice("path", 2, 2), lambda x: F.regexp_extract(x, r"ex\.org/(.*)>$", 1)), " ").alias("way"))


def _parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.infer(with_schema(lift(spark, sf_dir, [customers()]), (name("Customer"), V.SUBCLASS, name("Agent")), (name("Agent"), V.SUBCLASS, name("Party"))), only={"cax-sco"})


@query("select 'cax-sco' as rule, count(*) as n from customer union all select 'truncated', count(*) + 1 from customer")
def explain_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships of Party with a budget for their own step and nothing below."""
    reasoned = _parties(spark, sf_dir)
    targets = reasoned.filter((col("p") == V.TYPE) & (col("o") == name("Party")))
    return rules.explain(reasoned, targets, max_facts=2 * targets.count()).groupBy("rule").agg(F.count("*").alias("n"))


@query("select c_custkey as id, cls, depth from customer, (values ('Party', 2), ('Agent', 1), ('Customer', 0)) t(cls, depth)")
def explain_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasoned = _parties(spark, sf_dir)
    found = rules.depth(rules.explain(reasoned, reasoned.filter((col("p") == V.TYPE) & (col("o") == name("Party")))))
    return found.filter(col("p") == V.TYPE).select(key("s").alias("id"), terms.local_name(col("o")).alias("cls"), "depth")


@query("select c_custkey as id, cls, inferred from customer, (values ('Customer', false), ('Customer', true), ('Agent', true), ('Party', true)) t(cls, inferred)")
def export_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is saved without and with inferred triples."""
    reasoned = _parties(spark, sf_dir)
    parts = [rdf.exported(reasoned, flag).filter(col("p") == V.TYPE).select(key("s").alias("id"), terms.local_name(col("o")).alias("cls"), F.lit(flag).alias("inferred")) for flag in (False, True)]
    return parts[0].unionByName(parts[1])


@query("select user_id as s, event_type as o, p from (select *, row_number() over (partition by user_id, event_type order by event_id desc) as k from events), (values ('did'), ('acted')) t(p) where k = 1 and value >= 30")
def scheduled_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasoning over the first half of a log, brought up to date with its second half, which has removals: a full run."""
    log = changelog(spark, sf_dir)
    middle = (log.agg(F.max("batch")).collect()[0][0] or 0) // 2
    schema = with_schema(log.limit(0).select("s", "p", "o"), (name("did"), V.SUBPROPERTY, name("acted")))
    first = cut(changes.replay(schema, log, until_batch=middle))
    reasoned = rules.update(first, rules.infer(first), log.filter(col("batch") > middle))
    return P.dataset(reasoned).filter(col("p").isin(name("did"), name("acted"))).select(key("s").alias("s"), terms.lex(col("o")).alias("o"), terms.local_name(col("p")).alias("p"))
