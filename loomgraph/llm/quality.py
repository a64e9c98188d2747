"""Quality by Bradley-Terry pairwise ranking: document scores learnt from preference pairs by logistic loss on feature
differences, and a threshold at a quantile of the scores."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.words import Words, pieces
from loomgraph.plans.shared import staged

#: Labelled rows that meet in a bucket, those of the rarer class there at least, and preference pairs for each row of the rarer class.
BUCKET, RARE, PAIRS_EACH = 4000, 64, 16
#: Values that the driver sorts for a quantile.
SORTED = 10_000
RIDGE = 1e-3
FEATURES = ("log_words", "word_bytes", "long_words", "symbols", "marked_ends", "capitals", "digits", "lone_symbols", "distinct", "top_word", "repeats", "distinct_pairs", "lines")

_KIND = np.zeros(256, np.int8)  # 0 letter or other, 1 symbol, 2 capital, 3 digit
for _c in range(33, 127):
    _KIND[_c] = 2 if chr(_c).isupper() else 3 if chr(_c).isdigit() else 1 if not chr(_c).isalnum() else 0
_PLAIN = np.isin(np.arange(256), [ord(c) for c in ".,;:?'\")"])


def _sums(per_word: np.ndarray, words: Words) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(per_word, dtype=float)])
    return total[words.first[1:]] - total[words.first[:-1]]


def features(words: Words) -> np.ndarray:
    """One row for each text: length, word shape, symbols, capitals, digits, repetition. A text without words has zeros."""
    n = np.diff(words.first).astype(float)
    some = np.maximum(n, 1)
    size = (words.end - words.start).astype(float)
    bytes_ = np.maximum(_sums(size, words), 1)
    kinds = _KIND[words.data]

    def share(kind: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kinds == kind)])
        return _sums(total[words.end] - total[words.start], words) / bytes_

    last = words.data[words.end - 1]
    marked = (_KIND[last] == 1) & ~_PLAIN[last]
    row = np.repeat(np.arange(len(n)), n.astype(int))
    same = np.zeros(len(row))
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (row[1:] == row[:-1])
    distinct, top, pairs = (np.zeros(len(n)) for _ in range(3))
    for i in np.flatnonzero(n):
        own = words.hash[words.row(i)]
        _, count = np.unique(own, return_counts=True)
        distinct[i], top[i] = len(count), count.max()
        pairs[i] = len(np.unique(own[1:] * np.uint64(3) + own[:-1])) + 1
    newline = np.concatenate([[0], np.cumsum(words.data == 10)])
    lines = newline[words.end[words.first[1:] - 1]] - newline[words.start[np.minimum(words.first[:-1], len(words.start) - 1)]] if len(words.start) else np.zeros(len(n))
    out = np.stack([
        np.log1p(n), _sums(size, words) / some, _sums(size > 12, words) / some, share(1), _sums(marked, words) / some, share(2), share(3),
        _sums((size == 1) & marked, words) / some, distinct / some ** 0.9, top / some, _sums(same, words) / some, pairs / some, np.where(n > 0, lines, 0) / some,
    ], axis=1)
    return np.where(n[:, None] > 0, out, 0.0)


def featured(docs: DataFrame) -> DataFrame:
    """doc_id, x (an array of the features) for (doc_id, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, words in pieces(batch.column("text"), lower=False):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:high], pa.array(list(features(words)), pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.mapInArrow(work, "doc_id long, x array<double>")


@dataclass(frozen=True)
class Ranking:
    """score = logistic(log(0.7 / 0.3) + weights . (x - centre) / scale - cut), so the quantile cut scores ``at``."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    at: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.log(self.at / (1 - self.at)) + self.raw(x) - self.cut, -30, 30)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(FEATURES))


def _summed(rows: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of what ``of`` gives for all rows' x, some rows at a time; the driver gets one sum of each task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(of(_matrix(batch.column("x"))) for batch in batches if batch.num_rows)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["total"])

    return np.array([math.fsum(x) for x in zip(*(r["total"] for r in rows.select("x").mapInArrow(work, "total array<double>").collect()), strict=True)])


def differences(z: np.ndarray, label: np.ndarray, seed: int) -> np.ndarray:
    """Pairs of a good row and a bad one: every row of both kinds is in one at least, and each about as often as others of its kind."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return np.zeros((0, z.shape[1]))
    rng = np.random.default_rng(seed)
    n = max(PAIRS_EACH * min(len(good), len(bad)), len(good), len(bad))
    even = lambda rows: np.concatenate([rng.permutation(rows) for _ in range(-(-n // len(rows)))])[:n]
    return z[even(good)] - z[even(bad)]


def _paired(rows: DataFrame, counts: dict[int, int], centre: np.ndarray, scale: np.ndarray, seed: int) -> DataFrame:
    """(x): the differences of pairs of all labelled rows, which meet by hash buckets. Rows of a rare kind go to several buckets, so that none lacks it."""
    buckets = -(-sum(counts.values()) // BUCKET)
    rare = min(counts, key=counts.get)
    copies = min(buckets, -(-RARE * buckets // counts[rare]))
    shift = F.explode(F.sequence(F.lit(0), F.when(F.col("label") == rare, copies - 1).otherwise(0)))
    dealt = rows.withColumn("shift", shift).withColumn("bucket", F.pmod(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(buckets)) + F.col("shift"), F.lit(buckets)).cast("int"))

    def work(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id").combine_chunks()
        x = _matrix(table.column("x").combine_chunks())
        d = differences(np.clip((x - centre) / scale, -8, 8), table.column("label").to_numpy(), seed + key[0].as_py())
        return pa.table({"x": pa.array(list(d), pa.list_(pa.float64()))})

    return dealt.select("bucket", "doc_id", "label", "x").groupBy("bucket").applyInArrow(work, "x array<double>")


def _nth(values: DataFrame, n: int) -> float:
    """The n-th smallest raw score, from 0, by counts of ever narrower bins."""
    rows, low, high = values, *values.agg(F.min("raw"), F.max("raw")).collect()[0]
    while low < high:
        place = F.least(F.floor((F.col("raw") - low) / (high - low) * 1024), F.lit(1023))
        for b in sorted(rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high")).collect()):
            if n < b["n"]:
                break
            n -= b["n"]
        low, high = b["low"], b["high"]
        rows = values.filter(F.col("raw").between(low, high))
        if b["n"] <= SORTED:
            return sorted(r["raw"] for r in rows.collect())[n]
    return low


def learn(rows: DataFrame, at: float = 0.7, seed: int = 11) -> Ranking:
    """Fits to pairs of all ``rows`` (doc_id, label, x): a good row is preferred to a bad one. The cut is the score quantile at the share of bad rows, midway to the
    next score. Each Newton step is a job over the pairs; numbers of the model are rounded, so that the order of sums does not show."""
    counts = {k: 0 for k in (0, 1)} | {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n, width = sum(counts.values()), len(FEATURES)
    if not all(counts.values()):
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0 if counts[1] else 1.0, at)
    rounded = lambda x: np.array([float(f"{v:.9g}") for v in np.atleast_1d(x)])
    centre = rounded(_summed(rows, lambda x: x.sum(axis=0)) / n)
    scale = rounded(np.sqrt(_summed(rows, lambda x: ((x - centre) ** 2).sum(axis=0)) / n) + 1e-9)
    pairs = staged(_paired(rows, counts, centre, scale, seed))
    many = pairs.count()
    w = np.zeros(width)
    for _ in range(50):

        def step(d: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            return np.concatenate([d.T @ p, ((d * (p * (1 - p))[:, None]).T @ d).ravel()])

        sums = _summed(pairs, step) / many
        change = np.linalg.solve(sums[width:].reshape(width, width) + RIDGE * np.eye(width), sums[:width] - RIDGE * w)
        w = w + change
        if np.abs(change).max() < 1e-8:
            break
    model = Ranking(centre, scale, rounded(w), 0.0, at)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch.column("x"))))], ["raw"])

    raw = staged(rows.select("x").mapInArrow(work, "raw double"))
    k = counts[0]
    return Ranking(centre, scale, model.weights, float(rounded((_nth(raw, k - 1) + _nth(raw, min(k, n - 1))) / 2)[0]), at)


def held_out(modulus: int = 4, remainder: int = 2):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    Learns from all rows with ``labels.quality`` that are not held out. Features are made once for every row and staged.
    Null and empty texts have features 0 and a score like any. Without labels of both kinds all scores are equal. Of labels that
    contradict each other for one id the larger counts; of rows of ``docs`` that repeat an id the smallest text. Rows
    that repeat, and texts that tie, get one score each. An empty table gives no rows. Other columns are not looked at, whatever their names.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.filter("quality is not null and doc_id is not null").filter(~held_out()).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("label"))
    described = staged(featured(given))
    met = staged(described.join(known, "doc_id").groupBy("doc_id").agg(F.max("label").alias("label"), F.min("x").alias("x"), F.count("*").alias("n")))
    learnt, again = met.filter("n = 1").select("doc_id", "label", "x"), met.filter("n > 1").select("doc_id", "label")
    if not again.isEmpty():
        least = featured(given.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")))
        learnt = staged(learnt.unionByName(least.join(again, "doc_id").select("doc_id", "label", "x")))
    model = learn(learnt, threshold)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score(_matrix(batch.column("x")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    scored = described.mapInArrow(work, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
