"""Components of edges, few and many."""

import random

import pytest

from loomgraph.plans import components as C


@pytest.mark.parametrize("few", [0, 30, 1000])
def test_components_of_stars_chains_and_loops(spark, monkeypatch, few):
    monkeypatch.setattr(C, "HELD", 50)
    rng = random.Random(3)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 3), (200, 201), (200, 201)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(30)]
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in label:
        for a, b in edges:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
    assert got == label
    text = lambda x: None if x is None else f"n{x:04d}"
    named = spark.createDataFrame([(text(x), text(y)) for x, y in edges], "a string, b string").repartition(3)
    assert {r["node"]: r["component"] for r in C.components(named, few=few).collect()} == {text(k): text(v) for k, v in label.items()}
