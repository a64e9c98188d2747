"""Sameness by representatives, joins with hubs, paths from bound ends, unbound variables, label index, pages, stream state, layout by predicate."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomgraph import vocab as V
from loomgraph.operators import analytics, paging, patterns as P, rules, sameness, search
from loomgraph.plans.layout import GROUP, Layout
from loomgraph.plans.shared import hub_join
from loomgraph.sources.lift import rdf_list, triples
from loomgraph.streaming import incremental


def n(x):
    return f"<http://e/{x}>"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files_read(df):
    """How many files the scans of a plan open."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


# --- sameness

SAME = [
    (n("a"), V.SAME, n("b")), (n("c"), V.SAME, n("b")), (n("p"), V.SAME, n("q")), (n("x"), n("p"), n("a")), (n("c"), n("r"), '"1"'), (n("k1"), V.TYPE, n("K")), (n("k2"), V.TYPE, n("K")), (n("k1"), n("id"), n("a")), (n("k2"), n("id"), n("c")),
    (n("K"), V.KEY, "_:k"), *rdf_list("_:k", [n("id")]), (n("k2"), n("likes"), n("z")), (n("K"), V.SUBCLASS, n("L")), (n("s"), n("sub"), n("t")), (n("sub"), V.SUBPROPERTY, V.SAME), (n("t"), n("r"), n("s")),
]


def test_representatives_expand_to_the_closure(spark):
    given = triples(spark, SAME)
    closed = {tuple(r) for r in rules.infer(given).select("s", "p", "o").collect()}
    merged = sameness.infer_merged(given)
    assert {tuple(r) for r in merged.closure().collect()} == closed
    kept = merged.triples.collect()
    assert len(kept) == len({(r["s"], r["p"], r["o"]) for r in kept}) < len(closed)
    assert {r["x"]: r["same"] for r in merged.members.collect()} == {n("a"): n("a"), n("b"): n("a"), n("c"): n("a"), n("p"): n("p"), n("q"): n("p"), n("k1"): n("k1"), n("k2"): n("k1"), n("s"): n("s"), n("t"): n("s")}
    # asked on demand
    asked = P.scan(merged.triples, merged.pattern((n("k2"), n("likes"), "?z")))
    assert rows(asked) == [(n("z"),)]
    assert rows(sameness.same_pairs(merged, spark.createDataFrame([(n("c"),), (n("z"),)], "x string"))) == [(n("c"), n("a")), (n("c"), n("b")), (n("c"), n("c"))]
    assert rules.conflicts(merged.triples.unionByName(spark.createDataFrame([(n("a"), V.DIFFERENT, n("a"), 0, None)], merged.triples.schema))).count() == 1
    none = sameness.infer_merged(given.limit(0))
    assert none.triples.isEmpty() and none.members.isEmpty()
    with pytest.raises(ValueError, match="vocabulary"):
        sameness.infer_merged(triples(spark, [(V.TYPE, V.SAME, V.LABEL)]))


def test_a_large_group_adds_a_row_a_member(spark):
    given = spark.range(10_000).select(F.lit(n("m")).alias("s"), F.lit(V.SAME).alias("p"), F.concat(F.lit("<http://e/m/"), "id", F.lit(">")).alias("o")).unionByName(triples(spark, [(n("m/77"), n("p"), n("v"))]))
    merged = sameness.infer_merged(given)
    assert merged.members.count() == 10_001 and merged.triples.count() == 2
    assert merged.expand(P.scan(merged.triples, ("?s", n("p"), "?o")), ["s"]).count() == 10_001


# --- hubs


def test_joins_split_hubs(spark):
    rng = random.Random(1)
    left = spark.createDataFrame([(rng.choice("abcdefghij") if rng.random() > 0.3 else "hub", i) for i in range(6000)], "k string, l int")
    right = spark.createDataFrame([(rng.choice("abcdefghijz") if rng.random() > 0.3 else "hub", i) for i in range(300)], "k string, r int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        want = left.join(right, "k")
        got = hub_join(left, right, ["k"], each=60)
        assert rows(got.select("l", "r", "k")) == rows(want.select("l", "r", "k"))
        sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id().alias("task")).count().collect())
        assert len(sizes) > 40 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
        assert rows(hub_join(left, right.limit(0), ["k"])) == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rules_with_hubs_and_many_schema_solutions_give_the_same(spark, monkeypatch):
    rows_ = [(n("t"), V.TYPE, V.TRANSITIVE), *[(n(f"x{i}"), n("t"), n("hub")) for i in range(30)], *[(n("hub"), n("t"), n(f"y{i}")) for i in range(30)], (n("A"), V.UNION, "_:u"), *rdf_list("_:u", [n("B"), n("C"), n("D")]), (n("b"), V.TYPE, n("B")), (n("B"), V.SUBCLASS, n("Z"))]
    want = rows(rules.infer(triples(spark, rows_)))
    monkeypatch.setattr(rules, "HUB_TRIPLES", 0)
    monkeypatch.setattr(rules, "MAX_SOLUTIONS", 1)
    assert rows(rules.infer(triples(spark, rows_))) == want
    monkeypatch.setattr(rules, "MAX_SCHEMA", 3)
    assert rows(rules.infer(triples(spark, rows_))) == want


# --- paths


def test_paths_from_bound_ends(spark):
    rng = random.Random(4)
    graph = triples(spark, sorted({(n(rng.randrange(12)), n(rng.choice("pq")), n(rng.randrange(12))) for _ in range(30)}) + [(n(i), n("far"), n(i + 1)) for i in range(100, 130)])
    nodes = [n(3), n(7), n(100)]
    starts, ends = (spark.createDataFrame([(x,) for x in nodes], f"{c} string") for c in "ab")
    p, q = n("p"), n("q")
    for path in (p, ("inv", p), ("plus", p), ("star", p), ("opt", p), ("seq", p, ("star", q), ("inv", p)), ("alt", ("plus", q), ("seq", p, q)), ("plus", ("alt", p, ("inv", q))), ("inv", ("seq", p, ("plus", q))), ("not", p), ("inv", ("not", p)), ("star", ("seq", p, q)), ("plus", n("far"))):
        whole = P.step(graph, path)
        assert rows(P.paths_from(graph, path, starts)) == rows(whole.filter(F.col("a").isin(nodes))), path
        assert rows(P.paths_to(graph, path, ends)) == rows(whole.filter(F.col("b").isin(nodes))), path


# --- unbound variables


def compatible(a, b):
    return all(a[c] is None or b[c] is None or a[c] == b[c] for c in a.keys() & b.keys())


@pytest.mark.parametrize("shared", [["x"], ["x", "y"], ["x", "y", "z"]])
def test_unbound_variables_agree_as_in_sparql(spark, shared):
    rng = random.Random(len(shared))
    make = lambda extra, k: [{**{c: rng.choice([None, "1", "2"]) for c in shared}, extra: str(i % 5)} for i in range(k)]
    a, b = make("l", 14), make("r", 9)
    left, right = (spark.createDataFrame([tuple(r.values()) for r in side], ", ".join(f"{c} string" for c in side[0])) for side in (a, b))
    bound = lambda r: {c for c in shared if r[c] is not None}
    key = lambda r: str(sorted((k, v) for k, v in r.items()))
    got = lambda df: sorted(key(r.asDict()) for r in df.collect())
    assert got(P.minus(left, right)) == sorted(key(x) for x in a if not any(compatible(x, y) and bound(x) & bound(y) for y in b))
    for negated in (False, True):
        assert got(P.exists(left, right, negated)) == sorted(key(x) for x in a if any(compatible(x, y) for y in b) != negated)
    merge = lambda x, y: {c: x.get(c) if x.get(c) is not None else y.get(c) for c in {**x, **y}}
    met = [(x, y) for x in a for y in b if compatible(x, y) and y["r"] < "3"]
    want = [merge(x, y) for x, y in met] + [{**x, "r": None} for x in a if not any(x is u for u, _ in met)]
    assert got(P.optional(left, right, F.col("r") < "3")) == sorted(map(key, want))
    values = [{c: r[c] for c in (*shared, "r")} for r in b]
    assert got(P.values(left, values)) == sorted(key(merge(x, y)) for x in a for y in values if compatible(x, y))


def test_plans_of_optional_and_minus_have_no_nested_loop(spark):
    graph = triples(spark, [(n("a"), n("p"), n("b")), (n("b"), n("q"), n("c"))])
    left, right = P.scan(graph, ("?x", n("p"), "?y")), P.scan(graph, ("?y", n("q"), "?z"))
    some = P.optional(left, right)
    assert P.unsure(left) == set() and P.unsure(some) == {"z"} and P.unsure(P.union(left, right)) == {"x", "z"}
    loose = P.minus(P.join(left, P.scan(graph, ("?x", n("p"), "?w"))), some.select("x", "y", F.col("z").alias("w")))
    for df in (some, P.minus(left, right), P.exists(left, right), loose, P.minus(some, right.select("z", "y"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    # the case of a solution that is unbound where the other is bound
    one, two = spark.createDataFrame([("1", None)], "a string, b string"), spark.createDataFrame([("1", "2")], "a string, b string")
    assert P.minus(one, two).isEmpty() and P.exists(one, two).count() == 1


# --- label index and pages


def test_label_index_equals_the_scan(spark):
    graph = triples(spark, [(n("Aa"), V.LABEL, '"Haus am See"@de'), (n("Aa"), V.LABEL, '"aaaa"'), (n("b"), V.LABEL, '"a\U0001f600b한글"'), (n("b"), n("p"), '"see"'), ("_:c", V.LABEL, '""'), ('"lit"', V.LABEL, '"Seele"'), (n("d"), n("q"), n("See")), (n("Aa"), V.LABEL, '"' + "ab" * 3000 + '"')])
    index = search.label_index(graph)
    for text in ("see", "SEE", "s", "aa", "aaa", "aaaa", "aaaaa", "am s", "\U0001f600b", "한글", "글", "e/aa", "zzz", "ab" * 40, "_:c", "http://e/", "see>", ""):
        assert rows(index.search(text)) == rows(analytics.search(graph, text)), text
    assert files_read(index.search("haus")) * 5 < files_read(spark.read.parquet(index.path))


def test_pages_by_key(spark):
    data = [(i % 7, f"v{i % 50:02d}", i) for i in range(1003)]
    listing = paging.pages(spark.createDataFrame(data, "a int, b string, c int").repartition(5), ["a", "b"], size=10)
    assert (listing.rows, listing.pages) == (1003, 101)
    want = sorted(data)
    for k in (0, 1, 63, 64, 99, 100):
        assert [tuple(r) for r in listing.page(k).collect()] == want[10 * k : 10 * k + 10]
    assert listing.page(101).isEmpty() and files_read(listing.page(70)) < files_read(spark.read.parquet(listing.path))
    empty = paging.pages(spark.createDataFrame([], "a int"), ["a"])
    assert empty.pages == 0 and empty.page(0).isEmpty()


# --- streams


def test_a_batch_that_dies_half_way_leaves_nothing(spark, tmp_path, monkeypatch):
    schema = "s string, p string, o string"
    batches = [[(n("A"), V.SUBCLASS, n("B"))], [(n("x"), V.TYPE, n("A"))], [(n("B"), V.SUBCLASS, n("C")), (n("y"), V.TYPE, n("B"))]]
    source, folder, checkpoint = (str(tmp_path / x) for x in ("in", "state", "check"))
    run = lambda: incremental.reason_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source), folder, checkpoint).awaitTermination(300)
    commit = incremental._commit
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(source)
        if i == 1:
            monkeypatch.setattr(incremental, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(Exception, match="lost"):
                run()
            monkeypatch.setattr(incremental, "_commit", commit)
            assert len(incremental.commits(spark, folder)) == 1 and incremental.state(spark, folder).count() == 1
        run()
    assert sorted(incremental.commits(spark, folder)) == [0, 1, 2]
    want = rules.infer(triples(spark, [t for b in batches for t in b])).select("s", "p", "o")
    assert rows(incremental.state(spark, folder).select("s", "p", "o")) == rows(want)
    # a batch that was committed and is run again changes nothing
    before = rows(incremental.state(spark, folder))
    run()
    assert rows(incremental.state(spark, folder)) == before


# --- layout


def test_patterns_read_the_folders_of_their_predicate(spark):
    files = Layout.new(spark)
    names = [n(f"p{i}") for i in range(40)]
    for k in range(2):
        files.add(triples(spark, [(n(f"s{i}"), p, n(f"o{k}")) for i, p in enumerate(names)]))
    whole = files.read([0, 1])
    one = P.scan(whole, ("?s", names[3], "?o"))
    assert GROUP in whole.columns and rows(one) == [(n("s3"), n("o0")), (n("s3"), n("o1"))]
    groups = len({f.split("predicate_group=")[1].split("/")[0] for f in whole.inputFiles()})
    assert files_read(one) < files_read(whole) / groups * 3
    assert "PartitionFilters: [isnotnull(predicate_group" in one._jdf.queryExecution().executedPlan().toString()
    assert rows(P.step(whole, ("alt", names[0], names[1]))) == sorted((n(f"s{i}"), n(f"o{k}")) for i, k in itertools.product(range(2), range(2)))
