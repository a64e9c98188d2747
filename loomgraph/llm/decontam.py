"""Benchmark decontamination by pigeonhole edit matching.

An item of m words may differ from a passage by k = floor(rate * m) word edits. Cut into k + 1 pieces, at least one
piece occurs unchanged, wherever the edits are. Pieces of all items are found in one Aho-Corasick pass over a text;
each hit fixes where the item would lie, and Myers' bit-parallel distance over words confirms it there.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
#: Characters of items that one broadcast automaton holds; more items are matched in further passes.
MAX_PATTERN_CHARS = 20_000_000


def normal(text: str | None) -> list[str]:
    """Lower-case words of letters and digits."""
    return _WORD.findall((text or "").lower())


def cut_pieces(words: list[str], budget: int) -> list[tuple[int, list[str]]]:
    """(place, words) of budget + 1 consecutive pieces of near equal length."""
    n, k = len(words), min(budget + 1, len(words))
    edges = [i * n // k for i in range(k + 1)]
    return [(a, words[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def nearest_end(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """(distance, end): the least edit distance of ``pattern`` to any run of ``text``, and where the first such run ends."""
    m = len(pattern)
    where: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        where[w] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance = full, 0, m
    best = (m, 0)
    for j, w in enumerate(text, 1):
        eq = where.get(w, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        hp, hn = down | (~(d0 | up) & full), d0 & up
        distance += bool(hp & top) - bool(hn & top)
        hp = (hp << 1) & full
        hn = (hn << 1) & full
        up, down = hn | (~(d0 | hp) & full), hp & d0
        if distance < best[0]:
            best = (distance, j)
    return best


class Matcher:
    """Items by a running number, and the automaton of their pieces. Ids may be null or repeated."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float) -> None:
        self.ids = [i for i, _ in items]
        self.items = {k: normal(text) for k, (_, text) in enumerate(items)}
        self.budget = {i: int(rate * len(w)) for i, w in self.items.items()}
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, words in self.items.items():
            for place, piece in cut_pieces(words, self.budget[i]) if words else []:
                found[" " + " ".join(piece) + " "].append((i, place))
        self.automaton = ahocorasick.Automaton()
        for piece, at in found.items():
            self.automaton.add_word(piece, (len(piece), at))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def hits(self, text: str | None) -> list[dict]:
        """The best place of each item that occurs in the text within its budget, in words of the normal form."""
        words = normal(text)
        if not words or not self.any:
            return []
        line = " " + " ".join(words) + " "
        raw = list(self.automaton.iter(line))
        if not raw:
            return []
        number, at = {}, 0
        for k, w in enumerate(words):
            number[at] = k
            at += len(w) + 1
        windows: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for end, (length, items) in raw:
            k = number[end - length + 1]
            for i, place in items:
                b, m = self.budget[i], len(self.items[i])
                windows[i].add((max(0, k - place - b), min(len(words), k - place + m + b)))
        out = []
        for i, spans in sorted(windows.items()):
            best, joined = None, []
            for low, high in sorted(spans):
                if joined and low <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], high)
                else:
                    joined.append([low, high])
            for low, high in joined:
                distance, end = nearest_end(self.items[i], words[low:high])
                if distance <= self.budget[i] and (best is None or distance < best["distance"]):
                    best = {"item_id": self.ids[i], "distance": distance, "end_word": low + end}
            if best:
                out.append(best)
        return out


def blocks_of(benchmark: DataFrame, rate: float) -> Iterator[Matcher]:
    """Matchers over the items in blocks of bounded size; the driver holds one block at a time."""
    items: list[tuple[int | None, str]] = []
    size = 0
    for r in benchmark.filter("text is not null").select("item_id", "text").dropDuplicates().orderBy("item_id", "text").toLocalIterator():
        if items and size + len(r["text"]) > MAX_PATTERN_CHARS:
            yield Matcher(items, rate)
            items, size = [], 0
        items.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if items:
        yield Matcher(items, rate)


_HIT = "item_id: bigint, distance: int, end_word: int"


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` in its order of columns doc_id, contaminated, hits (item_id, distance in words, end_word).

    ``rate``: word edits allowed per word of an item, rounded down. Null and empty texts have no hits, nor do items
    without words. Each text of an item_id has a hit of its own, texts without one a null item_id. Columns of other names are not looked at.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("hits", F.array().cast(f"array<struct<{_HIT}>>"))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end_word", pa.int32())]))
    for matcher in blocks_of(benchmark, rate):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                hits = [(before or []) + known.hits(text.as_py()) for text, before in zip(batch.column("text"), batch.column("hits").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(hits, kind)], ["doc_id", "text", "hits"])

        given = given.mapInArrow(work, f"doc_id long, text string, hits array<struct<{_HIT}>>")
    return given.select("doc_id", (F.size("hits") > 0).alias("contaminated"), "hits")


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.2) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns. Null and empty texts stay."""
    for matcher in blocks_of(benchmark, rate):
        shared = docs.sparkSession.sparkContext.broadcast(matcher)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.hits(text.as_py()) for text in batch.column("text")], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
