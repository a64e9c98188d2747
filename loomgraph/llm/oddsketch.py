"""MinHash near-dedup with odd sketches: MinHash samples folded into parity bitmaps whose XOR population counts estimate
high similarities, for candidates that share a band; links are confirmed on the full shingle sets.

The steps, for documents with one shingle set taken as one node:

1. Every document gives its set's size and key, K MinHash samples as bands, and the odd sketch of the samples.
2. Nodes that share a band meet in its bucket. There sketches are compared until each node hangs together with all that
   the sketch does not rule out; only each such component's star around its smallest node leaves the bucket.
3. The stars' components are groups: two nodes that share a band and pass the sketch are in one group.
4. In each group the full sets are compared, again until the components of true links are known, and leave as stars.
   A pair inside one component needs no comparison, so the stars have the components of all links.

A bucket or group beyond a block's size is dealt into blocks, and then one node for each component found meets those of the
other blocks, until they fit a block or get no fewer (``linked``). What then is outside the largest component of its bucket
meets the whole bucket in pairs of blocks, so every two nodes that no component holds together have been compared. A giant group
of copies so costs its own size, and no task holds more than two blocks. With similarity 0.85 two sets share none of 32 bands of
4 once in 10 ** 10 pairs, and the sketch has five standard errors to spare.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.words import Words, grams, mixed, pieces
from loomgraph.plans.components import components
from loomgraph.plans.shared import attach, staged

BANDS, ROWS, BITS = 32, 4, 512
SAMPLES = BANDS * ROWS
BUCKET_BLOCK, SET_BLOCK = 1024, 256
_ODD = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mixed(np.arange(1001, SAMPLES + 1001, dtype=np.uint64))


def shingle_sets(words: Words, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; fewer than ``size`` words are one shingle, none are none."""
    out = []
    for i in range(len(words.first) - 1):
        own = words.hash[words.row(i)]
        if len(own) >= size:
            out.append(np.unique(grams(own, size)))
        else:
            out.append(mixed(grams(own, len(own)) + np.uint64(len(own))) if len(own) else own)
    return out


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES minima for each (non-empty) set."""
    if not sets:
        return np.zeros((0, SAMPLES), np.uint64)
    every, start = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    return np.stack([np.minimum.reduceat(every * _ODD[j] + _ADD[j], start) for j in range(SAMPLES)], axis=1)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """BITS parity bits for each row of samples, as bytes."""
    n = len(samples)
    place = (mixed(samples ^ _ADD[None, :]) % np.uint64(BITS)).astype(np.int64) + np.arange(n)[:, None] * BITS
    odd = np.bincount(place.ravel(), minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1)


def similarity(differing: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that goes with a number of differing bits."""
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1e-9, 1 - 2 * differing / BITS))


def most_differing(threshold: float) -> int:
    """The number of differing bits that a pair of this similarity exceeds only beyond five standard errors."""
    low = threshold - 5 * math.sqrt(threshold * (1 - threshold) / SAMPLES)
    return math.ceil(BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - low) / BITS))) + 4


def spanning(n: int, close: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Stars over the components of the graph in which ``close(i, others)`` flags the neighbours of i: (smallest member, other member).

    A node is compared with those only that no component has taken yet.
    """
    edges, rest = [], np.arange(n)
    while len(rest) > 1:
        root, queue, rest = int(rest[0]), [int(rest[0])], rest[1:]
        while queue and len(rest):
            near = close(queue.pop(), rest)
            taken = rest[near].tolist()
            edges += [(root, j) for j in taken]
            queue += taken
            rest = rest[~near]
    return edges


def _signed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, words in pieces(batch.column("text"), lower=True):
            sets = shingle_sets(words, size)
            some = [i for i, s in enumerate(sets) if len(s)]
            samples = minhashes([sets[i] for i in some])
            bands = mixed(grams_of_rows(samples))
            sketch = odd_sketches(samples)
            keys, sketches, listed = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            for k, i in enumerate(some):
                keys[i] = np.array([mixed(sets[i] + np.uint64(1)).sum(), mixed(sets[i] ^ _ADD[0]).sum()]).tobytes() + len(sets[i]).to_bytes(8, "little")
                sketches[i], listed[i] = sketch[k].tobytes(), bands[k].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[low:high], pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), pa.array(listed, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "sketch", "bands"],
            )


def grams_of_rows(samples: np.ndarray) -> np.ndarray:
    """A hash of each band, by its number and its samples."""
    out = np.broadcast_to(_ADD[:BANDS], (len(samples), BANDS)).copy()
    for r in range(ROWS):
        out = mixed(out + samples[:, r::ROWS] * _ODD[r])
    return out


def _grouped(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Runs of whole groups, from batches sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in key]
        new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        first = tuple(c[0] for c in columns)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        edge = int(new[-1]) if len(new) else 0
        if edge:
            yield pa.Table.from_batches([*held, batch.slice(0, edge)])
            held = []
        held.append(batch.slice(edge))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _edges(table: pa.Table, key: list[str]) -> np.ndarray:
    columns = [table.column(c).to_numpy() for c in key]
    n = table.num_rows
    return np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1, [n]])


def _pairs(a: list, b: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


_KEY = ["bucket", "bi", "bj"]


def _candidates(batches: Iterator[pa.RecordBatch], most: int, ratio: float) -> Iterator[pa.RecordBatch]:
    for table in _grouped(batches, _KEY):
        edge, node, size = _edges(table, _KEY), table.column("node").to_numpy(), table.column("n_shingles").to_numpy()
        bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        count = np.diff(edge)
        two = edge[:-1][count == 2]
        near = (np.bitwise_count(bits[two] ^ bits[two + 1]).sum(axis=1) <= most) & (np.minimum(size[two], size[two + 1]) >= ratio * np.maximum(size[two], size[two + 1]))
        a, b = node[two[near]].tolist(), node[two[near] + 1].tolist()
        for k in np.flatnonzero(count > 2):
            low, high = edge[k], edge[k + 1]
            own, n = bits[low:high], size[low:high]

            def close(i: int, others: np.ndarray, own=own, n=n) -> np.ndarray:
                return (np.bitwise_count(own[others] ^ own[i]).sum(axis=1) <= most) & (np.minimum(n[others], n[i]) >= ratio * np.maximum(n[others], n[i]))

            for i, j in spanning(high - low, close):
                a.append(node[low + i])
                b.append(node[low + j])
        if a:
            yield _pairs(a, b)


def links_among(sets: list[np.ndarray], part: int, whole: int) -> list[tuple[int, int]]:
    """Stars over the components of the pairs with whole * intersection >= part * union."""
    size = np.array([len(s) for s in sets])

    def close(i: int, others: np.ndarray) -> np.ndarray:
        fit = whole * np.minimum(size[others], size[i]) >= part * np.maximum(size[others], size[i])
        out = np.zeros(len(others), bool)
        if fit.any():
            chosen = others[fit]
            every = np.concatenate([sets[j] for j in chosen])
            at = np.minimum(np.searchsorted(sets[i], every), size[i] - 1)
            shared = np.add.reduceat((sets[i][at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(size[chosen])[:-1]]))
            out[fit] = whole * shared >= part * (size[chosen] + size[i] - shared)
        return out

    return spanning(len(sets), close)


def _confirmed(batches: Iterator[pa.RecordBatch], size: int, part: int, whole: int) -> Iterator[pa.RecordBatch]:
    for table in _grouped(batches, _KEY):
        edge, node = _edges(table, _KEY), table.column("node").to_numpy()
        text = table.column("text")
        for low, high in zip(edge[:-1], edge[1:], strict=True):
            if high - low < 2:
                continue
            own = pa.concat_arrays(text.slice(low, high - low).chunks)
            sets = [s for _, _, words in pieces(own, lower=True) for s in shingle_sets(words, size)]
            if found := links_among(sets, part, whole):
                yield _pairs([node[low + i] for i, _ in found], [node[low + j] for _, j in found])


def linked(members: DataFrame, payload: DataFrame, block: int, compare: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(node, component) of the nodes that ``compare`` links inside a bucket, for ``members`` (bucket, node, n), ``n`` being the bucket's size.

    ``compare`` gets whole (bucket, bi, bj) with the columns of ``payload`` (node, ...) and gives stars (a, b) over the components of the
    pairs among them; of two nodes in one component not every link is looked for.
    """

    def met(dealt: DataFrame) -> DataFrame:
        rows = dealt.join(payload.hint("merge"), "node").select("bucket", "bi", "bj", *payload.columns)
        return staged(rows.repartition(*_KEY).sortWithinPartitions(*_KEY, "node").mapInArrow(compare, "a long, b long"))

    def block_of(size: Column, salt: int) -> Column:
        return F.pmod(F.xxhash64("bucket", "node", F.lit(salt)), F.greatest(F.lit(1), F.ceil(size / block))).cast("int")

    edges = met(members.withColumn("bi", block_of(F.col("n"), 0)).withColumn("bj", F.col("bi")))
    found = components(edges)
    large = staged(members.filter(F.col("n") > block).select("bucket", "node", "n"))
    if large.isEmpty():
        return found
    payload = staged(payload.join(large.select("node").distinct(), "node", "left_semi"))
    left = large.groupBy("bucket").agg(F.max("n").alias("before"))
    for salt in range(1, 20):
        # one node for each component of a bucket; buckets go on as long as that halves them and they don't fit a block yet
        parts = staged(large.join(found, "node", "left").groupBy("bucket", F.coalesce("component", "node").alias("component")).agg(F.min("node").alias("node"), F.count("*").alias("size")))
        sizes = parts.groupBy("bucket").agg(F.count("*").alias("n"), F.max(F.struct("size", "component")).alias("top"))
        sizes = staged(sizes.join(left, "bucket").filter("n > 1"))
        if sizes.isEmpty():
            return found
        again = sizes.filter((F.col("n") * 2 <= F.col("before")) & (F.col("before") > block))
        if again.isEmpty():
            break
        reps = parts.join(again.select("bucket", "n"), "bucket").select("bucket", "node", "n")
        # what is known already are the stars of the components
        more = met(reps.withColumn("bi", block_of(F.col("n"), salt)).withColumn("bj", F.col("bi")))
        found = components(found.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))
        left = sizes.select("bucket", F.col("n").alias("before"))
    # what is outside its bucket's largest component, by blocks, and the whole bucket, by blocks: each of the ones meets each of the others
    whole = large.join(sizes.select("bucket", F.col("top.component").alias("top")), "bucket").join(found, "node", "left").withColumn("out", F.coalesce("component", "node") != F.col("top"))
    whole = staged(whole.select("bucket", "node", "n", "out"))
    outside = whole.groupBy("bucket").agg(F.count(F.when(F.col("out"), 1)).alias("few"))
    both = whole.join(outside, "bucket").withColumn("own", block_of(F.col("n"), 0)).withColumn("mine", block_of(F.col("few"), -1))
    count = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / block)).cast("int")
    ones = both.filter("out").select("bucket", "node", F.col("mine").alias("bi"), F.explode(F.sequence(F.lit(0), count("n") - 1)).alias("bj"))
    others = both.select("bucket", "node", F.explode(F.sequence(F.lit(0), count("few") - 1)).alias("bi"), F.col("own").alias("bj"))
    known = found.select(F.col("component").alias("a"), F.col("node").alias("b"))
    return components(known.unionByName(met(ones.unionByName(others).distinct())))


def near_duplicates(docs: DataFrame, shingle: int = 5, part: int = 80, whole: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest id reached by links), kept.

    Linked: whole * intersection >= part * union of the shingle sets. Null, empty and blank texts have empty sets and
    are linked with nothing. Rows that repeat an id are kept all or not at all; a row without id is linked by its set
    but never kept unless its set is empty. Columns of other names are not looked at.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = staged(given.mapInArrow(lambda b: _signed(b, shingle), "doc_id long, n_shingles long, set_key binary, sketch binary, bands array<bigint>"))
    sets = staged(signed.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")).filter("node is not null"))
    nodes = staged(attach(signed.select("doc_id", "n_shingles", "set_key", "sketch", "bands"), sets, "set_key", "rows", "doc_id").filter("doc_id = node").dropDuplicates(["node", "set_key"]).select("node", "n_shingles", "sketch", "bands"))
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    several = staged(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    met = attach(rows, several, "bucket", "n", "node").filter("n is not null").select("bucket", "node", "n")
    threshold = part / whole
    groups = linked(met, nodes.select("node", "n_shingles", "sketch"), BUCKET_BLOCK, lambda b: _candidates(b, most_differing(threshold), threshold))
    sizes = staged(groups.groupBy("component").agg(F.count("*").alias("n")))
    grouped = staged(attach(groups, sizes, "component", "n", "node").select("node", F.col("component").alias("bucket"), "n"))
    # the texts that any comparison needs leave their table once; merged at every size, as a broadcast that only small inputs allow would hide what moves on large ones
    texts = staged(given.select(F.col("doc_id").alias("node"), "text").join(grouped.select("node").hint("merge"), "node", "left_semi"))
    found = linked(grouped, texts, SET_BLOCK, lambda b: _confirmed(b, shingle, part, whole))
    reached = staged(sets.join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"), "rows"))
    return attach(signed.select("doc_id", "n_shingles", "set_key"), reached, "set_key", "rows", "doc_id").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("n_shingles") == 0))


def deduplicated(docs: DataFrame, shingle: int = 5, part: int = 80, whole: int = 100) -> DataFrame:
    """``docs`` without the documents that a smaller id stands for. Rows of one id go together; rows without an id stay."""
    gone = near_duplicates(docs, shingle, part, whole).filter("not kept").select(F.col("doc_id").alias("_gone")).dropDuplicates()
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone["_gone"], "left_anti")
