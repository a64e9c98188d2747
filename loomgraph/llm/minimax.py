"""Sharding by minimax contiguous partition: the smallest capacity for which a greedy cut of the ordered groups fits the shards.

Groups are equal texts (two texts with one 64-bit hash stay together). Groups beyond a fair share come first in the order, the
largest first, and fill a shard each; the others follow by their hash. The capacity is exact for that order. Within it the
cuts are even: each is as near as it can be to a fair share of what is left, and no shard stays empty while groups are left.
The driver never sees the groups: it holds the sums of 65,536 hash cells and splits only those cells in which a cut may fall,
256-fold a round, until they are single groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.shared import cut, prefix_sums

TOP_SHIFT, STEP = 48, 8
#: Cells that one round may split; the driver gets 256 rows for each at most.
CELLS_A_ROUND = 1024


def _sums(slim: DataFrame, shift: int) -> list:
    return slim.groupBy(F.shiftright("key", shift).alias("cell")).agg(F.sum("size").alias("b"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()


def _greedy(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Prefix sums at the greedy cuts: each shard takes whole atoms while they fit."""
    cuts, at = [], 0
    for _ in range(shards):
        k = int(np.searchsorted(ends, at + capacity, "right"))
        at = max(at, int(ends[k - 1]) if k else 0)
        cuts.append(at)
    return cuts


def _smallest(ends: np.ndarray, low: int, shards: int) -> int:
    total = int(ends[-1])
    high = total
    while low < high:
        middle = (low + high) // 2
        if _greedy(ends, middle, shards)[-1] == total:
            high = middle
        else:
            low = middle + 1
    return low


def even_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """How many atoms lie before each cut: no shard above the capacity, each as near as can be to a fair share of what is left."""
    n, total = len(ends), int(ends[-1])
    sums = np.concatenate([[0], ends])  # sums[i]: the first i atoms
    least = [n]  # fewest atoms before a cut, so that the shards after it hold the rest
    for _ in range(shards - 1):
        least.append(int(np.searchsorted(sums, sums[least[-1]] - capacity, "left")))
    least.reverse()
    cuts, at = [], 0
    for j in range(shards - 1):
        low, high = max(least[j], min(at + 1, n)), int(np.searchsorted(sums, sums[at] + capacity, "right")) - 1
        high = max(low, min(high, n - (shards - 1 - j)))  # an atom for each shard after it, if there are so many
        want = sums[at] + (total - sums[at]) / (shards - j)
        k = int(np.clip(np.searchsorted(sums, want), low, high))
        at = k - 1 if k > low and want - sums[k - 1] < sums[k] - want else k
        cuts.append(at)
    return cuts


def _oversize(slim: DataFrame, atoms: list[tuple], shards: int) -> list[tuple[int, int]]:
    """(size, key) of the groups beyond a fair share of what is left without those before them, the largest first."""
    looked, known, out = set(), [], []
    total = sum(a[2] for a in atoms)
    while len(out) < shards - 1:
        share = total / (shards - len(out))
        heavy = [a for a in atoms if a[2] > share and a[0] not in looked]
        if heavy:  # under ``shards`` cells for each share
            looked |= {a[0] for a in heavy}
            cells = slim.sparkSession.createDataFrame([(a[0] >> TOP_SHIFT,) for a in heavy], "cell long")
            inside = slim.join(F.broadcast(cells), F.shiftright("key", TOP_SHIFT) == cells["cell"], "left_semi")
            known += [(r["b"], r["key"]) for r in inside.groupBy("key").agg(F.sum("size").alias("b")).orderBy(F.desc("b"), "key").limit(shards).collect()]
        found = max((x for x in known if x not in out), default=(0, 0), key=lambda x: (x[0], -x[1]))
        if found[0] <= share:
            return out
        out.append(found)
        total -= found[0]
    return out


def capacity_and_cuts(slim: DataFrame, shards: int) -> tuple[int, list[int], list[int]]:
    """The smallest feasible capacity, the keys that fill a shard each, and the last key of every other shard but the last, for ``slim`` (key long, size long)."""
    atoms = [(r["cell"] << TOP_SHIFT, TOP_SHIFT, r["b"], r["lo"], r["hi"]) for r in _sums(slim, TOP_SHIFT)]
    own = _oversize(slim, atoms, shards)
    most, alone = max((b for b, _ in own), default=0), [k for _, k in own]
    if own:
        slim = slim.filter(~F.col("key").isin(alone))
        cells = {k >> TOP_SHIFT for k in alone}
        again = slim.filter(F.shiftright("key", TOP_SHIFT).isin(list(cells)))
        atoms = [a for a in atoms if a[0] >> TOP_SHIFT not in cells] + [(r["cell"] << TOP_SHIFT, TOP_SHIFT, r["b"], r["lo"], r["hi"]) for r in _sums(again, TOP_SHIFT)]
        shards -= len(own)
    if not atoms:
        return most, alone, []
    while True:
        atoms.sort()
        ends = np.cumsum([a[2] for a in atoms], dtype=np.int64)
        starts = ends - np.array([a[2] for a in atoms])
        single = np.array([a[3] == a[4] for a in atoms])
        total = int(ends[-1])
        low = max(-(-total // shards), max((a[2] for a, s in zip(atoms, single, strict=True) if s), default=0))
        best = _smallest(ends, low, shards)
        lows = _greedy(ends, low, shards)
        high, need = 0, np.zeros(len(atoms), bool)
        for j in range(shards):
            high += best
            k = int(np.searchsorted(ends, high, "right"))
            if k < len(atoms) and single[k] or k == len(atoms):
                high = int(ends[k - 1]) if k else 0
            need |= ~single & (starts < high) & (ends > lows[j])
        cuts = even_cuts(ends, best, shards)
        if not need.any() and len(atoms) > 1:  # and the cells next to an even cut, which could be evener inside them
            near = [i for c in cuts for i in (c - 1, c) if 0 <= i < len(atoms)]
            need[near] = ~single[near]
        chosen = sorted(np.flatnonzero(need), key=lambda i: -atoms[i][2])[:CELLS_A_ROUND]
        if not chosen:
            return max(most, best), alone, [atoms[c - 1][4] for c in cuts if 0 < c < len(atoms)]
        split = []
        for shift in {atoms[i][1] for i in chosen}:
            cells = slim.sparkSession.createDataFrame([(int(atoms[i][0] >> shift),) for i in chosen if atoms[i][1] == shift], "cell long")
            inside = slim.join(F.broadcast(cells), F.shiftright("key", shift) == cells["cell"], "left_semi")
            split += [(r["cell"] << (shift - STEP), shift - STEP, r["b"], r["lo"], r["hi"]) for r in _sums(inside, shift - STEP)]
        atoms = [a for i, a in enumerate(atoms) if i not in set(chosen)] + split


def minimax_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard, capacity.

    Null text: 0 bytes, no checksum, a group of its own. An empty table gives no rows. Rows that repeat keep
    a slot each. A group beyond a fair share (one text of a third of all rows) has a shard to itself, as groups aren't split; shards
    stay empty only if there are fewer groups than shards. Other columns of ``docs`` are not looked at, whatever their names.
    """
    text = F.col(text_col)
    slim = cut(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("key")
        )
    )
    capacity, alone, cuts = capacity_and_cuts(slim, shards)
    shard = sum(((F.col("key") > F.lit(c)).cast("int") for c in cuts), F.lit(len(alone)))
    for j, k in enumerate(alone):
        shard = F.when(F.col("key") == k, j).otherwise(shard)
    placed = slim.withColumn("shard", shard.cast("int"))
    slotted = prefix_sums(placed, ["shard"], ["doc_id", "key"], F.lit(1), "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"))
