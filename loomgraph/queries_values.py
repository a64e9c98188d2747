"""Registered queries of value functions, aggregates, order and property paths, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph import vocab as V
from loomgraph.functions import terms
from loomgraph.functions import values as X
from loomgraph.operators import patterns as P
from loomgraph.queries import col, customer, customers, key, located, name, nations, orders, placed, query, suppliers, with_schema
from loomgraph.sources.lift import Mapping, entity, lift

XSD = V.XSD


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [customers(balance=terms.literal(F.format_string("%.2f", "c_acctbal"), f"{XSD}decimal"), segment=terms.literal(col("c_mktsegment"), lang="en"), name=terms.literal(col("c_name")), key=terms.integer(col("c_custkey")))])
    return P.bgp(graph, [("?c", name("balance"), "?b"), ("?c", name("segment"), "?s"), ("?c", name("name"), "?n"), ("?c", name("key"), "?k")])


def _lex(*cells) -> list:
    return [terms.lex(c).alias(n) for c, n in cells]


@query("""select c_custkey as id, upper(c_mktsegment) as upper, lower(c_mktsegment) as lower, substr(c_name, 3, 5) as part, split_part(c_name, '#', 1) as before, split_part(c_name, '#', 2) as after,
    replace(c_name, '#', '%23') as encoded, c_name || '/' || c_mktsegment as joined, regexp_replace(c_name, '0+', '-', 'g') as replaced, length(c_name) as size, contains(c_name, '11') as has, starts_with(c_mktsegment, 'B') as b, ends_with(c_name, '7') as seven
    from customer where regexp_matches(c_name, '[1-4]$')""")
def sparql_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s, text = col("n"), col("s"), lambda x: terms.literal(F.lit(x))
    found = _customers(spark, sf_dir).filter(X.regex(n, "[1-4]$"))
    return found.select(
        key("c").alias("id"), *_lex((X.ucase(s), "upper"), (X.lcase(s), "lower"), (X.substr(n, 3, 5), "part"), (X.strbefore(n, text("#")), "before"), (X.strafter(n, text("#")), "after"), (X.encode_for_uri(n), "encoded"), (X.concat(n, text("/"), s), "joined"), (X.replace(n, "0+", "-"), "replaced")),
        X.number(X.strlen(n)).cast("long").alias("size"), X.contains(n, text("11")).alias("has"), X.strstarts(s, text("B")).alias("b"), X.strends(n, text("7")).alias("seven"),
    )


@query("""select c_custkey as id, abs(c_acctbal) as abs, floor(c_acctbal) as floor, ceil(c_acctbal) as ceil, floor(c_acctbal + 0.5) as round, c_acctbal + 2 * c_custkey as sum, c_acctbal - 0.5 as less, case when c_custkey <> 0 then round(10.0 / c_custkey, 3) end as share,
    case when c_acctbal < 0 then 'debt' else 'fine' end as state from customer""")
def sparql_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, k = col("b"), col("k")
    number = lambda x, n: X.number(x).alias(n)
    two, half, ten = terms.integer(F.lit(2)), terms.literal(F.lit("0.5"), f"{XSD}decimal"), terms.integer(F.lit(10))
    state = X.if_(X.less(b, terms.integer(F.lit(0))), terms.literal(F.lit("debt")), terms.literal(F.lit("fine")))
    return _customers(spark, sf_dir).select(
        key("c").alias("id"), number(X.abs_(b), "abs"), number(X.floor(b), "floor"), number(X.ceil(b), "ceil"), number(X.round_(b), "round"), number(X.add(b, X.multiply(two, k)), "sum"), number(X.subtract(b, half), "less"), F.round(X.number(X.divide(ten, k)), 3).alias("share"), terms.lex(state).alias("state"),
    )


@query("select c_custkey as id, md5(c_name) as m, sha1(c_name) as s, sha256(c_name) as t from customer")
def sparql_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select(key("c").alias("id"), *_lex((X.md5(col("n")), "m"), (X.sha1(col("n")), "s"), (X.sha(col("n"), 256), "t")))


@query("""select o_orderkey as id, year(o_orderdate)::bigint as year, month(o_orderdate)::bigint as month, day(o_orderdate)::bigint as day, hour(o_orderdate)::bigint as hours, minute(o_orderdate)::bigint as minutes, second(o_orderdate)::bigint as seconds, 'Z' as tz, 'PT0S' as zone
    from orders where o_orderdate >= timestamp '1995-06-01'""")
def sparql_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [orders(made=terms.literal(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"), f"{XSD}dateTime"))])
    found = P.scan(graph, ("?o", name("made"), "?d")).filter(~X.less(col("d"), terms.literal(F.lit("1995-06-01T00:00:00Z"), f"{XSD}dateTime")))
    part = lambda f, n: X.number(f(col("d"))).cast("long").alias(n)
    return found.select(key("o").alias("id"), part(X.year, "year"), part(X.month, "month"), part(X.day, "day"), part(X.hours, "hours"), part(X.minutes, "minutes"), part(X.seconds, "seconds"), *_lex((X.tz(col("d")), "tz"), (X.timezone(col("d")), "zone")))


@query("""select c_custkey as id, trunc(c_acctbal)::bigint as whole, c_acctbal as real, c_acctbal <> 0 as truth, c_custkey::varchar as text, null::bigint as wrong, 'decimal' as kind, 'en' as lang from customer""")
def sparql_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = col("b")
    return _customers(spark, sf_dir).select(
        key("c").alias("id"), X.number(X.to_integer(b)).cast("long").alias("whole"), X.number(X.to_double(b)).alias("real"), X.condition(X.to_boolean(b)).alias("truth"), terms.lex(X.to_string(col("k"))).alias("text"), X.number(X.to_integer(col("n"))).cast("long").alias("wrong"),
        F.regexp_extract(X.datatype(b), r"#(\w+)>$", 1).alias("kind"), terms.lex(X.lang(col("s"))).alias("lang"),
    )


@query("""select kind, count(*) as n from (select 'iri' as kind from customer union all select 'number' from customer union all select 'string' from customer union all select 'tagged' from customer union all select 'string' from nation union all select 'iri' from nation) group by kind""")
def sparql_term_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the values of the graph are."""
    graph = lift(spark, sf_dir, [Mapping("customer", customer(), None, {name("in"): located("c"), name("balance"): terms.double(col("c_acctbal")), name("name"): terms.literal(col("c_name")), name("segment"): terms.literal(col("c_mktsegment"), lang="en")}, keyed=True), Mapping("nation", entity("nation", col("n_nationkey")), None, {name("name"): terms.literal(col("n_name")), name("partOf"): entity("region", col("n_regionkey"))}, keyed=True)])
    o = col("o")
    kind = F.when(X.is_iri(o), "iri").when(X.is_blank(o), "blank").when(X.is_numeric(o), "number").when(X.lang_matches(terms.lang(o), "*"), "tagged").when(X.is_literal(o), "string")
    return graph.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""select o_custkey as id, count(*) as n, count(distinct o_orderstatus) as kinds, round(avg(o_totalprice), 4) as mean, round(sum(o_totalprice), 2) as total, min(o_totalprice) as least, max(o_totalprice) as most,
    string_agg(distinct o_orderstatus, '/' order by o_orderstatus) as list, min(o_orderstatus) as one from orders group by o_custkey having avg(o_totalprice) > 250000""")
def sparql_aggregates_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [orders(placedBy=placed(), price=terms.literal(F.format_string("%.2f", "o_totalprice"), f"{XSD}decimal"), status=terms.literal(col("o_orderstatus")))])
    found = P.bgp(graph, [("?o", name("placedBy"), "?c"), ("?o", name("price"), "?p"), ("?o", name("status"), "?s")])
    p, s = col("p"), col("s")
    made = found.groupBy(key("c").alias("id")).agg(X.count(p).alias("n"), X.count(s, distinct=True).alias("kinds"), X.avg(p).alias("a"), X.sum_(p).alias("t"), X.min_(p).alias("l"), X.max_(p).alias("m"), X.group_concat(s, "/", distinct=True).alias("g"), X.sample(s).alias("x"))
    made = made.filter(~X.less(col("a"), terms.integer(F.lit(250000))))
    return made.select("id", "n", "kinds", F.round(X.number(col("a")), 4).alias("mean"), F.round(X.number(col("t")), 2).alias("total"), X.number(col("l")).alias("least"), X.number(col("m")).alias("most"), *_lex((col("g"), "list"), (col("x"), "one")))


@query("""select c_custkey as id, coalesce(count(o_orderkey), 0) as n, round(coalesce(sum(o_totalprice), 0), 2) as total, null::double as broken from customer left join orders on o_custkey = c_custkey and o_orderpriority = '1-URGENT' group by c_custkey""")
def sparql_aggregates_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum over nothing is 0; a sum of names is unbound."""
    urgent = F.when(col("o_orderpriority") == "1-URGENT", placed())
    graph = lift(spark, sf_dir, [customers(name=terms.literal(col("c_name"))), orders(placedBy=urgent, price=terms.double(col("o_totalprice")))])
    paid = P.bgp(graph, [("?o", name("placedBy"), "?c"), ("?o", name("price"), "?p")])
    made = P.optional(P.scan(graph, ("?c", name("name"), "?n")), paid).groupBy(key("c").alias("id")).agg(X.count(col("p")).alias("n"), X.sum_(col("p")).alias("t"), X.sum_(col("n")).alias("broken"))
    return made.select("id", "n", F.round(X.number(col("t")), 2).alias("total"), X.number(col("broken")).alias("broken"))


@query("""select kind, text from (select 2 as kind, 0 as v, 'http://ex.org/customer/' || c_custkey as text from customer where c_acctbal > 0 union all select 3, c_acctbal, c_acctbal::varchar from customer where c_acctbal < 0 union all select 4, 0, c_name from customer where c_acctbal = 0 union all select 4, 0, n_name from nation)
    order by kind desc, v desc, text desc limit 400""")
def sparql_order_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last terms in the order of ORDER BY: literals, numbers by value, IRIs."""
    balance = col("c_acctbal")
    value = F.when(balance > 0, customer()).when(balance < 0, terms.double(balance)).otherwise(terms.literal(col("c_name")))
    graph = lift(spark, sf_dir, [Mapping("customer", customer(), None, {name("value"): value}, keyed=True), Mapping("nation", entity("nation", col("n_nationkey")), None, {name("value"): terms.literal(col("n_name"))}, keyed=True)])
    found = P.scan(graph, ("?x", name("value"), "?v")).orderBy(X.order_key(col("v")).desc()).limit(400)
    return found.select(X.order_key(col("v"))["kind"].alias("kind"), terms.lex(col("v")).alias("text"))


@query("select distinct c_mktsegment as segment, n_regionkey as region from customer join nation on n_nationkey = c_nationkey")
def sparql_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [customers(locatedIn=located("c"), segment=terms.literal(col("c_mktsegment"))), nations()])
    found = P.bgp(graph, [("?c", name("segment"), "?s"), ("?c", name("locatedIn"), "?n"), ("?n", name("partOf"), "?r")])
    return found.select("s", "r").distinct().select(terms.lex(col("s")).alias("segment"), key("r").alias("region"))


@query("select o_orderkey as ord, o_custkey as customer from orders join (select o_custkey as c, max(o_totalprice) as m from orders group by o_custkey) on c = o_custkey and m = o_totalprice where o_custkey is not null")
def sparql_subselect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's dearest orders: the inner query's variables join the outer ones."""
    graph = lift(spark, sf_dir, [orders(placedBy=placed(), price=terms.double(col("o_totalprice")))])
    paid = P.bgp(graph, [("?o", name("placedBy"), "?c"), ("?o", name("price"), "?p")])
    inner = paid.groupBy("c").agg(X.max_(col("p")).alias("p"))
    return P.join(paid, inner).select(key("o").alias("ord"), key("c").alias("customer"))


@query("select count(*) > 1000 as truncated, least(count(*), 1000) as n from orders")
def sparql_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row cap with its flag: 1,000 rows of all orders."""
    some, more = P.capped(P.scan(lift(spark, sf_dir, [orders()]), ("?o", V.TYPE, name("Order"))), 1000)
    return some.agg(F.lit(more).alias("truncated"), F.count("*").alias("n"))


@query("select o_orderkey as a, o_custkey as b from orders union all select c_custkey, c_nationkey from customer")
def sparql_path_alternative(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [orders(placedBy=placed()), customers(locatedIn=located("c"))])
    return P.step(graph, ("alt", name("placedBy"), name("locatedIn"))).select(key("a").alias("a"), key("b").alias("b"))


@query("select s_suppkey as a, s_nationkey as b from supplier union all select c_custkey, c_nationkey from customer")
def sparql_path_negated(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [customers(locatedIn=located("c"), segment=terms.literal(col("c_mktsegment"))), suppliers(sitsIn=located("s"))])
    return P.step(graph, ("not", name("segment"), V.TYPE)).select(key("a").alias("a"), key("b").alias("b"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomgraph.plans.shared import table

    here, later = (F.concat(F.lit("<http://ex.org/turn/"), col("conv_id"), F.lit("/"), col("turn") + i, F.lit(">")) for i in (0, 1))
    rows = table(spark, sf_dir, "conversations")
    return rows.select(here.alias("s"), F.lit(name("next")).alias("p"), later.alias("o")).join(rows.select(here.alias("o")), "o", "left_semi").select("s", "p", "o")


def _conv(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.regexp_extract("a", r"/(\d+)/\d+>$", 1).cast("long").alias("conv"), key("a").alias("a"), key("b").alias("b"))


_LONG = "(select conv_id, turn, count(*) over (partition by conv_id) as n from conversations)"


@query(f"select a.conv_id as conv, a.turn as a, b.turn as b from {_LONG} a join {_LONG} b on a.conv_id = b.conv_id and b.turn >= a.turn where a.n > 1")
def sparql_path_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conv(P.step(_turns(spark, sf_dir), ("star", name("next"))))


@query(f"select a.conv_id as conv, a.turn as a, b.turn as b from {_LONG} a join {_LONG} b on a.conv_id = b.conv_id and b.turn in (a.turn, a.turn + 1) where a.n > 1")
def sparql_path_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conv(P.step(_turns(spark, sf_dir), ("opt", name("next"))))


@query("select c_custkey as id from customer where c_acctbal is not null and exists (select 1 from nation where n_nationkey = c_nationkey) and c_acctbal in (select c_acctbal from customer where c_mktsegment = 'BUILDING' or c_acctbal < 0)")
def sparql_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of those with a place: the builders or debtors, COALESCE and || over unbound values."""
    graph = lift(spark, sf_dir, [customers(locatedIn=located("c"), debt=F.when(col("c_acctbal") < 0, terms.double(col("c_acctbal"))), segment=terms.literal(col("c_mktsegment")), balance=terms.double(col("c_acctbal"))), nations()])
    base = P.bgp(graph, [("?c", name("locatedIn"), "?n"), ("?n", name("partOf"), "?r"), ("?c", name("segment"), "?s"), ("?c", name("balance"), "?b")])
    found = P.optional(base, P.scan(graph, ("?c", name("debt"), "?d")))
    test = F.coalesce(X.less(col("d"), terms.integer(F.lit(0))), F.lit(False)) | X.one_of(col("s"), terms.literal(F.lit("BUILDING")))
    equal = found.filter(test).select(col("b").alias("b")).distinct()
    return P.exists(base.select("c", "b"), equal).select(key("c").alias("id"))


# --- the examples that are shown to people


@query("select 'Customer' as cls, count(*) as n from customer union all select 'Supplier', count(*) from supplier order by n desc, cls limit 50")
def example_instances_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [customers(), suppliers()])
    return P.scan(graph, ("?x", V.TYPE, "?c")).groupBy(terms.local_name(col("c")).alias("cls")).agg(F.countDistinct("x").alias("n")).orderBy(F.desc("n"), "cls").limit(50)


@query("select 'placedBy' as p, count(*) as n from orders union all select 'status', count(*) from orders union all select 'type', count(*) from orders")
def example_predicate_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [orders(placedBy=placed(), status=terms.literal(col("o_orderstatus")))])
    return graph.groupBy(terms.local_name(col("p")).alias("p")).agg(F.count("*").alias("n"))


@query("select n_nationkey as id, n_name as label from nation where contains(n_name, '1') order by label limit 100")
def example_label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.scan(lift(spark, sf_dir, [nations()]), ("?x", V.LABEL, "?l")).filter(X.contains(X.str_(col("l")), terms.literal(F.lit("1"))))
    return found.orderBy(X.order_key(col("l"))).limit(100).select(key("x").alias("id"), terms.lex(col("l")).alias("label"))


@query("select c_custkey as id from customer where c_acctbal <= 0")
def example_without_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [customers(wealth=F.when(col("c_acctbal") > 0, terms.double(col("c_acctbal"))))])
    return P.exists(P.scan(graph, ("?x", V.TYPE, name("Customer"))), P.scan(graph, ("?x", name("wealth"), "?w")), negated=True).select("x").distinct().select(key("x").alias("id"))


@query("select c_custkey as id from customer union all select s_suppkey from supplier")
def example_subclass_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a class or of any below it, by a path."""
    graph = with_schema(lift(spark, sf_dir, [customers(), suppliers()]), (name("Customer"), V.SUBCLASS, name("Agent")), (name("Supplier"), V.SUBCLASS, name("Agent")))
    below = P.step(graph.filter(col("p") == V.SUBCLASS), ("star", V.SUBCLASS)).filter(col("b") == name("Agent")).select(col("a").alias("t"))
    return P.join(P.scan(graph, ("?x", V.TYPE, "?t")), below).select(key("x").alias("id"))


@query("select o_custkey as customer, count(*) as n from orders where o_custkey is not null group by o_custkey order by n desc, customer limit 20")
def example_most_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = lift(spark, sf_dir, [orders(placedBy=placed())])
    return P.scan(graph, ("?o", name("placedBy"), "?c")).groupBy(key("c").alias("customer")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "customer").limit(20)
