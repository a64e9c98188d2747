"""Mixing sources to target weights: fixed-length blocks of words, multinomial source counts per output shard,
slots mapped through per-source pseudorandom index permutations, blocks joined by index."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.shared import cut, prefix_sums, rows_for, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: One row per source reaches the driver; more sources than this are refused, not cut off.
MAX_SOURCES = 1_000_000
CHUNK = 65_536


@dataclass(frozen=True)
class Source:
    code: int
    name: str | None
    size: int
    target: float
    take: int

    def slots(self, block: int) -> int:
        full, tail, rest = self.size // block, self.size % block, self.take % self.size if self.size else 0
        return 0 if not self.size else self.take // self.size * (full + (tail > 0)) + -(-rest // block)


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: float = 3.0) -> list[float]:
    """Targets by weight (repeating), none above ``most`` times its source's size; the excess is reshared by weight."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    total, held = share * sum(sizes), {i for i, s in enumerate(sizes) if not s}
    while True:
        free = [i for i in range(len(sizes)) if i not in held]
        left = total - sum(most * sizes[i] for i in held)
        each = left / sum(weight[i] for i in free) if free else 0.0
        over = {i for i in free if each * weight[i] > most * sizes[i]}
        if not over:
            return [most * sizes[i] if i in held else each * weight[i] for i in range(len(sizes))]
        held |= over


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of 0..n-1 for each ``key``: four Feistel rounds on the next even number of bits, walked until inside."""
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x, b, m, k = out[todo], bits[todo], mask[todo], key[todo]
        left, right = x >> b, x & m
        for r in range(4):
            mixed = (right + k + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(33)) & m)
        out[todo] = left << b | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _counts(sources: list[Source], block: int, shards: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(source, shard, first slot, slots): multinomial draws by what each source still owes; the quotas come out exactly."""
    rng = np.random.default_rng(seed)
    owed = np.array([s.slots(block) for s in sources], dtype=np.int64)
    first, rows = np.zeros_like(owed), []
    for shard in range(shards):
        room = int(owed.sum() // (shards - shard))
        drawn = np.zeros_like(owed)
        while room:
            left = owed - drawn
            got = np.minimum(left, rng.multinomial(room, left / left.sum()))
            drawn += got
            room -= int(got.sum())
        rows += [(s.code, shard, int(first[i]), int(drawn[i])) for i, s in enumerate(sources) if drawn[i]]
        first, owed = first + drawn, owed - drawn
    return rows


def _seed(seed: int, code: int, epoch: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}/{code}/{epoch}".encode(), digest_size=8).digest(), "big")


def _index(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        code, epoch, j, full = (batch.column(c).to_numpy() for c in ("code", "epoch", "j", "full"))
        pairs, which = np.unique(code.astype(np.int64) * 4 + epoch, return_inverse=True)
        keys = np.array([_seed(seed, int(p) // 4, int(p) % 4) for p in pairs], dtype=np.uint64)[which] if len(pairs) else np.zeros(0, np.uint64)
        inside = j < full
        index = j.copy()
        if inside.any():
            index[inside] = permuted(j[inside], full[inside], keys[inside])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index)], [*batch.schema.names, "block"])


def mix(docs: DataFrame, block: int = 256, shards: int = 16, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", uid_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix as two tables.

    members: uid, doc_id, size, source_size, target, one row per row of ``docs``. pieces: shard, slot, epoch,
    uid, from_word, to_word: the words that a slot takes of a document, in words of that document.

    Null texts and empty texts have size 0 and are never taken. The null source is a source and comes last.
    Documents lie in their source's stream in a hashed order; the last block of a source may be short, the
    last slot of a source takes only a block's first words so that the source's words equal its rounded target.
    No block is taken in more than three epochs. Columns of other names are not looked at.
    """
    spark = docs.sparkSession
    slim = cut(
        docs.select((F.col(uid_col) if uid_col else F.monotonically_increasing_id()).alias("uid"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    )
    found = slim.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = sorted(((r["source"], r["size"]) for r in found), key=lambda r: (r[0] is None, r[0] or ""))
    sources = [Source(i, name, size, t, min(round(t), 3 * size)) for i, ((name, size), t) in enumerate(zip(found, targets([s for _, s in found]), strict=True))]
    plan = spark.createDataFrame(
        [(s.code, s.name, s.size, s.target, s.take, s.size // block, s.slots(block)) for s in sources], "code long, name string, source_size long, target double, take long, full long, slots long"
    )
    known = slim.join(plan if len(sources) > 10_000 else F.broadcast(plan), slim["source"].eqNullSafe(plan["name"]))
    members = known.select("uid", "doc_id", "size", "source_size", "target")
    # by a hash of the id, so that the order is the same however the rows are dealt; rows that repeat an id by size
    placed = prefix_sums(known.filter("size > 0"), ["code"], ["doc_id", "size", "uid"], F.col("size"), "start", bucket=F.pmod(F.xxhash64("doc_id"), F.lit(1024)))
    parts = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))).select(
        "code", "block", "uid", (F.col("block") * block - F.col("start")).alias("shift"), F.greatest(F.lit(0), F.col("start") - F.col("block") * block).alias("lo"),
        F.least(F.lit(block), F.col("start") + F.col("size") - F.col("block") * block).alias("hi"),
    )
    draws = spark.createDataFrame(_counts(sources, block, shards, seed), "code long, shard int, first long, n long")
    chunks = draws.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(CHUNK)))).repartition(rows_for(spark, sum(s.slots(block) for s in sources), CHUNK), "code", "shard", "chunk")
    slots = chunks.withColumn("slot", F.explode(F.sequence(F.col("first") + F.col("chunk"), F.col("first") + F.least(F.col("n"), F.col("chunk") + CHUNK) - 1)))
    each = F.col("full") + F.when(F.col("source_size") % block > 0, 1).otherwise(0)
    rest = F.col("take") % F.col("source_size") % block
    slots = slots.join(plan if len(sources) > 10_000 else F.broadcast(plan), "code").select(
        "code", "shard", "slot", F.floor(F.col("slot") / each).alias("epoch"), (F.col("slot") % each).alias("j"), "full",
        F.when((F.col("slot") == F.col("slots") - 1) & (F.col("take") % F.col("source_size") > 0) & (rest > 0), rest).otherwise(block).alias("words"),
    )
    indexed = slots.mapInArrow(lambda batches: _index(batches, seed), "code long, shard int, slot long, epoch long, j long, full long, words long, block long")
    pieces = indexed.join(parts, ["code", "block"]).select(
        "shard", "slot", "epoch", "uid", (F.col("shift") + F.col("lo")).alias("from_word"), (F.col("shift") + F.least("hi", "words")).alias("to_word")
    )
    return members, pieces.filter("from_word < to_word")


def mixed_counts(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted)."""
    members, pieces = mix(docs, **options)
    taken = pieces.groupBy("uid").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return members.join(taken, "uid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for batch in batches:
        texts, row = [], batch.column("row")
        for text, spans, size in zip(row.field("text"), batch.column("spans").to_pylist(), batch.column("size").to_pylist(), strict=True):
            if sum(s["to_word"] - s["from_word"] for s in spans) == size:
                texts.append(text.as_py())
                continue
            at = [m.span() for m in word.finditer(text.as_py())]
            runs: list[list[int]] = []
            for s in sorted((s["from_word"], s["to_word"]) for s in spans):
                if runs and runs[-1][1] == s[0]:
                    runs[-1][1] = s[1]
                else:
                    runs.append(list(s))
            texts.append(" ".join(text.as_py()[at[a][0] : at[b - 1][1]] for a, b in runs))
        names = [f.name for f in row.type]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else row.field(n) for n in names], names)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for each document and each epoch that takes words of it, with those words' text.

    All columns of ``docs`` stay; n_chars, where there is one, becomes the new text's length.
    """
    given = staged(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("uid")))
    members, pieces = mix(given.select(*[F.col(f"row.{c}").alias(c) for c in ("doc_id", "text", "source")], "uid"), uid_col="uid", **options)
    spans = pieces.groupBy("uid", "epoch").agg(F.collect_list(F.struct("from_word", "to_word")).alias("spans")).join(members.select("uid", "size"), "uid")
    chosen = given.join(cut(spans.select("uid", "spans", "size")), "uid").select("row", "spans", "size")
    mixed = chosen.mapInArrow(_cut_texts, docs.schema)
    return mixed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else mixed
