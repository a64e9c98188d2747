"""Layout of triples by predicate."""


def test_layout_is_written_by_small_tasks(spark, monkeypatch):
    from loomgraph.plans import layout

    rows = spark.range(20_000).selectExpr("concat('<s', id, '>') as s", "'<p>' as p", "concat('<o', id % 7, '>') as o")
    monkeypatch.setattr(layout, "TASK_BYTES", layout.TASK_BYTES | {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k"})
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        files = layout.Layout.new(spark)
        found = files.read([files.add(rows.repartition(4))])
        assert len(found.inputFiles()) > 2 and found.count() == 20_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before


def test_neighbourhoods_and_explanations_are_made_by_small_tasks(spark, monkeypatch):
    """Also what is joined last: nothing but staged rows is left to whoever reads the result."""
    from loomgraph.operators import analytics, rules
    from loomgraph.plans import layout

    seen, plain = [], {"analytics": analytics.staged, "rules": rules.staged}
    for module in (analytics, rules):
        monkeypatch.setattr(module, "staged", lambda df, own=module.__name__.split(".")[-1]: seen.append((own, spark.conf.get("spark.sql.files.maxPartitionBytes"))) or plain[own](df))
    rows = spark.createDataFrame([("<a>", "<p>", "<b>", 0, None), ("<b>", "<p>", "<c>", 0, None)], "s string, p string, o string, level int, rule string")
    near = analytics.neighbourhood(rows, spark.createDataFrame([("<a>",)], "x string"), 2)
    assert sorted(tuple(r) for r in near.collect()) == [("<a>", 0), ("<b>", 1), ("<c>", 2)]
    said = rules.explain(rows, rows.select("s", "p", "o").union(spark.createDataFrame([("<x>", "<p>", "<y>")], "s string, p string, o string")), max_facts=1)
    assert sorted(r["rule"] for r in said.collect()) == ["not entailed", "truncated", "truncated"]
    assert "Join" not in said._jdf.queryExecution().optimizedPlan().toString()
    assert {own for own, _ in seen} == {"analytics", "rules"} and {size for _, size in seen} == {layout.TASK_BYTES["spark.sql.files.maxPartitionBytes"]}


def test_links_of_a_hub_are_not_dealt_by_it(spark, monkeypatch):
    from loomgraph.operators import analytics

    links = spark.range(300).selectExpr("'<hub>' as a", "concat('<n', id, '>') as x").union(spark.createDataFrame([("<b>", "<c>"), ("<d>", "<e>")], "a string, x string"))
    ends = spark.createDataFrame([("<hub>",), ("<b>",), ("<f>",)], "a string")
    few = analytics._near(links, ends, 3)
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(analytics, "MERGED_ROWS", 2)
    many = analytics._near(links, ends, 3)
    want = sorted([("<hub>", f"<n{i}>") for i in range(300)] + [("<b>", "<c>")])
    assert sorted(tuple(r) for r in few.collect()) == sorted(tuple(r) for r in many.collect()) == want


def test_given_triples_are_dealt_before_they_are_compared(spark, monkeypatch):
    """No task that reads a table holds its triples, and what a task compares is a small share of them, however few partitions the session has."""
    import re

    from loomgraph.operators import rules
    from loomgraph.plans import layout

    plans, plain = [], layout.Layout.add
    monkeypatch.setattr(layout.Layout, "add", lambda self, triples, many=True: plans.append(triples._jdf.queryExecution().executedPlan().toString()) or plain(self, triples, many))
    rows = spark.range(50).selectExpr("concat('<s', id % 40, '>') as s", "concat('<p', id % 2, '>') as p", "concat('<o', id % 20, '>') as o")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        found = rules.infer(rows, only=set())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
    assert found.count() == 40 and spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) is None
    dealt = re.search(r"Exchange hashpartitioning\(s[^()]*, (\d+)\)", plans[0])
    assert int(dealt[1]) == 200 and "Aggregate" in plans[0][: dealt.start()] and "Aggregate" not in plans[0][dealt.end() :]
