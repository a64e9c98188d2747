"""Substring dedup by level-wise doubling: windows repeated at one length alone are extended to twice that length.

The lengths are the wanted window halved until it is short, upwards. Below the last length a text gives only its
anchors: of each run of windows that would lie in one wanted window, the one with the smallest hash. Two
equal wanted windows hold equal anchors at equal places, so an anchor that is found once rules out every wanted
window around it. Texts without a repeated anchor drop out; in the others only the windows around repeated anchors
reach the next length. At the last length every window that is left counts, and those found twice are removed.

Equal texts have one hash: "found twice" means at two (text, place) pairs, and at the later lengths one row stands for
all rows of a text. A text that several rows hold repeats all its windows. Anchors have 64-bit hashes, as a false hit there
only keeps a window for the next length; at the last length windows are compared by two independent hashes of 64 bits, so of n windows
about n * n / 2 ** 129 pairs that differ count as equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.words import Words, grams, joined, mixed, pieces
from loomgraph.plans.shared import attach, cut, stage, staged, unstage

_OTHER = np.uint64(0xA24BAED4963EE407)
#: No length under this is used: shorter windows repeat by chance.
SHORTEST = 16


def lengths(window: int) -> list[int]:
    out = [window]
    while -(-out[0] // 2) >= SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def _minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest value of every ``width`` consecutive ones. Of equals the first, so equal windows have it at one
    offset: in a text with a period, windows that overlap then have different anchors."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, place, length = hashes, np.arange(len(hashes)), 1
    while length < width:
        step = min(length, width - length)
        left = least[: len(least) - step] <= least[step:]
        least, place, length = np.where(left, least[: len(least) - step], least[step:]), np.where(left, place[: len(place) - step], place[step:]), length + step
    return place[np.r_[True, place[1:] != place[:-1]]]


def _places(words: Words, i: int, length: int, window: int, around: np.ndarray | None, before: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the windows of row i that count at this length; ``around``: repeated places at the length before."""
    own = words.hash[words.row(i)]
    if len(own) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if around is None:
        spans = [(0, len(own))]
    else:
        slack = window - before
        low, high = np.maximum(0, around - slack), np.minimum(len(own), around + before + slack)
        new = np.flatnonzero(low[1:] > high[:-1]) + 1
        spans = list(zip(low[np.r_[0, new]], high[np.r_[new - 1, len(low) - 1]], strict=True))
    found = [(h[at], at + low) for low, high in spans if high - low >= window for h in [grams(own[low:high], length)] for at in [_minima(h, window - length + 1)]]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _digests(words: Words, kept: np.ndarray | None = None) -> pa.Array:
    return pa.array([hashlib.sha256(x).hexdigest() for x in joined(words, kept)], pa.string())


_ROWS = "doc_id long, text_key long, n_words long, sha string, h long, place int"
_WINDOWS = "text_key long, h long, h2 long, place int"


def _first(batches: Iterator[pa.RecordBatch], length: int, window: int) -> Iterator[pa.RecordBatch]:
    """A row for each document with its count and digest, and a row for each anchor of its text."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("h", pa.int64()), ("place", pa.int32())])
    for batch in batches:
        ids, keys = batch.column("doc_id"), batch.column("text_key").to_numpy()
        for low, high, words in pieces(batch.column("text")):
            counts = np.diff(words.first)
            n = high - low
            yield pa.RecordBatch.from_arrays(
                [ids[low:high], pa.array(keys[low:high]), pa.array(counts), _digests(words), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], schema=schema
            )
            found = [_places(words, i, length, window, None, 0) for i in range(n)]
            size = [len(f[0]) for f in found]
            if total := sum(size):
                h, place = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.nulls(total, pa.int64()), pa.array(np.repeat(keys[low:high], size)), pa.nulls(total, pa.int64()), pa.nulls(total, pa.string()), pa.array(h.view(np.int64)), pa.array(place.astype(np.int32))], schema=schema)


def _next(batches: Iterator[pa.RecordBatch], length: int, window: int, before: int) -> Iterator[pa.RecordBatch]:
    """``h2``: a second hash of the same words, over other word hashes."""
    for batch in batches:
        keys, places = batch.column("text_key").to_numpy(), batch.column("places")
        for low, high, words in pieces(batch.column("text")):
            others = mixed(words.hash ^ _OTHER)
            for_row = [grams(others[words.row(i)], length) for i in range(high - low)]
            found = [_places(words, i, length, window, np.sort(places[low + i].values.to_numpy()), before) for i in range(high - low)]
            size = [len(f[0]) for f in found]
            if sum(size):
                h, place = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                h2 = np.concatenate([other[f[1]] for other, f in zip(for_row, found, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys[low:high], size)), pa.array(h.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(place.astype(np.int32))], ["text_key", "h", "h2", "place"])


def _rest(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """For texts with repeated windows: words removed, spans removed and the digest of what is kept."""
    for batch in batches:
        keys, places = batch.column("text_key"), batch.column("places")
        for low, high, words in pieces(batch.column("text"), hashed=False):
            removed, spans, kept = [], [], np.ones(len(words.start), bool)
            for i in range(high - low):
                own = words.row(i)
                at = np.sort(places[low + i].values.to_numpy())
                steps = np.zeros(own.stop - own.start + 1, np.int64)
                steps[at] += 1
                steps[at + window] -= 1
                covered = np.cumsum(steps[:-1]) > 0
                kept[own] = ~covered
                edge = np.flatnonzero(np.diff(np.r_[False, covered, False]))
                removed.append(int(covered.sum()))
                spans.append([{"from_word": int(a), "to_word": int(b)} for a, b in edge.reshape(-1, 2)])
            kind = pa.list_(pa.struct([("from_word", pa.int64()), ("to_word", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:high], keys[low:high], pa.array(removed, pa.int64()), pa.array(spans, kind), _digests(words, kept)], ["doc_id", "text_key", "n_removed", "spans", "kept_sha256"])


def _repeated(rows: DataFrame, once: bool) -> DataFrame:
    """(text_key, places): the rows (text_key, key, place) whose window is also found at another place or in another text; ``once``: no two
    rows are of one place. A window that very many share is looked up by broadcast."""
    at = F.xxhash64("text_key", "place")
    found = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(at).alias("a"), F.max(at).alias("b")).filter("n > 1" if once else "a <> b")
    return attach(rows, cut(found.select("key", "n")), "key", "n", at).filter("n is not null").groupBy("text_key").agg(F.collect_set("place").alias("places"))


def repeated_substrings(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, spans (word ranges removed), kept_sha256.

    A word goes if a window of ``window`` words that covers it also starts anywhere else. Null and empty
    texts have no words. Documents under ``window`` words keep all. Ids may repeat or be null; rows that are
    equal repeat each other. Columns of other names are not looked at.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    first, *later = lengths(window)
    first_path = stage(given.mapInArrow(lambda b: _first(b, first, window), _ROWS))
    seen = docs.sparkSession.read.schema(_ROWS).parquet(first_path)
    members = staged(seen.filter("sha is not null").select("doc_id", "text_key", "n_words", "sha"))
    # one row of each text stands for it; several only if an id repeats with its text, and those are copies anyway
    held = members.groupBy("text_key").agg(F.min_by("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("doc_id"), F.count("*").alias("n"), F.max("n_words").alias("n_words"))
    texts_path = None
    rows, before, texts = seen.filter("sha is null").select("text_key", F.col("h").alias("key"), "place"), first, given
    for length in later:
        around = cut(_repeated(rows, once=before != first).join(held.select("text_key", "doc_id"), "text_key"))
        if before == first:
            unstage(docs.sparkSession, first_path)  # all windows of the first length: nothing reads them any more
        else:
            unstage(docs.sparkSession, rows_path)
        # the places travel with the text, so each level joins the texts once
        same = (texts["text_key"] == around["text_key"]) & texts["doc_id"].eqNullSafe(around["doc_id"])
        texts_path, last_path = stage(texts.join(around, same).select(texts["doc_id"], texts["text_key"], "text", "places")), texts_path
        single = docs.sparkSession.read.schema("doc_id long, text_key long, text string, places array<int>").parquet(texts_path)
        if last_path:
            unstage(docs.sparkSession, last_path)
        texts = single.drop("places")
        rows_path = stage(single.select("text_key", "text", "places").mapInArrow(lambda b, n=length, m=before: _next(b, n, window, m), _WINDOWS))
        rows = docs.sparkSession.read.schema(_WINDOWS).parquet(rows_path)
        rows = rows.select("text_key", F.struct("h", "h2").alias("key") if length == window else F.col("h").alias("key"), "place")
        before = length
    windows = cut(_repeated(rows, once=bool(later)))
    if later:
        unstage(docs.sparkSession, rows_path)
    copied = cut(held.filter((F.col("n") > 1) & (F.col("n_words") >= window)).select("text_key", "n"))
    partly = windows.join(copied, "text_key", "left_anti")
    changed = staged(texts.join(partly, "text_key").mapInArrow(lambda b: _rest(b, window), "doc_id long, text_key long, n_removed long, spans array<struct<from_word: bigint, to_word: bigint>>, kept_sha256 string"))
    once = changed.drop("doc_id").withColumn("all_gone", F.lit(False)).withColumn("n", F.lit(1).cast("long"))
    whole = copied.select("text_key", "n", F.lit(None).cast("long").alias("n_removed"), F.lit(None).cast("array<struct<from_word: bigint, to_word: bigint>>").alias("spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), F.lit(True).alias("all_gone"))
    result = cut(once.unionByName(whole))
    return attach(members, result, "text_key", "n", "doc_id").select(
        "doc_id", "n_words", F.when(F.col("all_gone"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("all_gone"), F.array(F.struct(F.lit(0).cast("long").alias("from_word"), F.col("n_words").alias("to_word")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<from_word: bigint, to_word: bigint>>"))).alias("spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )
