"""Connected components by contraction: spanning forests inside tasks, then rounds that merge each node with its smallest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.shared import attach, stage, unstage

#: So few edges are finished by one task; more are contracted until they are as few.
FEW_EDGES = 1 << 18
#: Edges that a task reads before it reduces them.
HELD = 1 << 20


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the numbers 0 to n - 1 that each one reaches by the edges (u, v)."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return label
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further


def _stars(edges: pa.Table, whole: bool) -> pa.RecordBatch:
    """Edges (u, v) as stars: each node v with the smallest node u it reaches; ``whole``: the smallest ones themselves as well."""
    both = pa.chunked_array([*edges.column("u").chunks, *edges.column("v").chunks], edges.schema.field("u").type).combine_chunks().dictionary_encode()
    nodes = both.dictionary
    order = pc.sort_indices(nodes.cast(pa.binary()) if pa.types.is_string(nodes.type) else nodes).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[both.indices.to_numpy()]
    label, own = roots(code[: len(edges)], code[len(edges) :], len(order)), np.arange(len(order))
    kept = own if whole else own[label != own]
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(order[x])) for x in (label[kept], kept)], ["u", "v"])


def _local(edges: DataFrame, whole: bool = False) -> DataFrame:
    """Each task's edges as stars; it holds HELD edges and the stars of those before."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held, rows = [*held, batch], rows + batch.num_rows
            if rows > HELD:
                held, rows = [_stars(pa.Table.from_batches(held), False)], 0
        if sum(b.num_rows for b in held):
            yield _stars(pa.Table.from_batches(held), whole)

    return edges.mapInArrow(work, edges.schema)


def _merged(edges: DataFrame) -> tuple[str, DataFrame]:
    """(path, rows (node, root, n)): every node with the local minimum that its chain of smallest neighbours ends at; n: its edges."""
    spark = edges.sparkSession
    ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = ends.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"), F.count("*").alias("n")).select("node", F.least("node", "m").alias("root"), "n")
    schema, path = now.schema, stage(now)
    while True:
        now = spark.read.schema(schema).parquet(path)
        stands = now.groupBy("root").agg(F.count("*").alias("size")).join(now.select(F.col("node").alias("root"), F.col("root").alias("far")), "root")
        stands_schema, stands_path = stands.schema, stage(stands)
        ahead = attach(now, spark.read.schema(stands_schema).parquet(stands_path), "root", "size", "node").select("node", F.col("far").alias("root"), "n", (F.col("far") != F.col("root")).alias("moved"))
        ahead_path = stage(ahead)
        moved = not spark.read.schema(ahead.schema).parquet(ahead_path).filter("moved").isEmpty()
        unstage(spark, path, stands_path)
        path = ahead_path
        if not moved:
            return path, spark.read.schema(schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b", few: int = FEW_EDGES) -> DataFrame:
    """(node, component): for each node of ``edges`` the smallest node it reaches. Edges may repeat; loops and nulls are ignored.

    Each task first reduces its edges to a spanning forest, so what is dealt is at most a row for each node and task. Beyond ``few`` edges, nodes merge with
    the local minima of their surroundings, which at least halves them a round; a node with very many edges is looked up by ``attach``. The last
    ``few`` edges are one task's.
    """
    spark = edges.sparkSession
    schema = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).schema
    read = lambda path: spark.read.schema(schema).parquet(path)
    path, merged = stage(_local(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v"))), []
    while read(path).count() > few:
        map_path, found = _merged(read(path))
        merged.append((map_path, found))
        ends = read(path)
        for end in ("u", "v"):
            ends = attach(ends, found.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"), "n"), end, "n", "v" if end == "u" else "u").drop("n")
        again = stage(_local(ends.select(F.col("u_root").alias("u"), F.col("v_root").alias("v")).filter("u <> v").distinct()))
        unstage(spark, path)
        path = again
    last = stage(_local(read(path).coalesce(1), whole=True))
    out = read(last).select(F.col("v").alias("node"), F.col("u").alias("component"))
    for map_path, found in reversed(merged):
        # a root that no edge is left of stands for itself
        stands = found.groupBy("root").agg(F.count("*").alias("size")).join(out, F.col("root") == out["node"], "left").select("root", F.coalesce("component", "root").alias("component"), "size")
        stands_schema, stands_path = stands.schema, stage(stands)
        wider = attach(found, spark.read.schema(stands_schema).parquet(stands_path), "root", "size", "node").select("node", "component")
        wider_path = stage(wider)
        unstage(spark, last, stands_path, map_path)
        last = wider_path
        out = spark.read.schema(wider.schema).parquet(last)
    unstage(spark, path)
    return out
