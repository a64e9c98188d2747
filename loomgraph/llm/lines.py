"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling; later copies of repeated line runs go.

A suffix is a document's lines from one line on. Its rank at length h is where suffixes with its first h lines start in
the sorted order of all suffixes that share h lines with another one; lines sort by their 64-bit hash. Ranks at
length 2 h come from pairs of ranks at length h, h lines apart. Suffixes of one rank are an interval whose longest common
prefix is h lines or more; a suffix alone at its length drops out, so the work shrinks with the repeats that are left.

Each place is taken in the deepest interval that also holds an earlier place: h lines from there on are a later copy. The
copies of a document overlap into its maximal repeated runs, and those go.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.shared import attach, prefix_sums, staged

#: Hash ranges along which the first ranks are summed.
RANGES = 1024


def _lines(docs: DataFrame) -> DataFrame:
    lines = docs.filter("text is not null").select("doc", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    return lines.select("doc", "doc_id", "line", F.xxhash64("content").alias("id")).dropDuplicates(["doc", "line"])


def _first_ranks(lines: DataFrame) -> tuple[DataFrame, int]:
    """(doc, doc_id, line, rank, first) of lines that occur twice or more, ``first`` being the first place of the rank; and how many there are."""
    classes = lines.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "doc", "line")).alias("first")).filter("n > 1").withColumn("range", F.shiftright("id", 54))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("range").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    starts = classes.groupBy("range").agg(F.sum("n").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # RANGES rows
    ranks = staged(classes.join(F.broadcast(starts), "range").select("id", (F.col("start") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("rank"), "first", "n"))
    total = ranks.agg(F.sum("n")).first()[0] or 0
    return attach(lines, ranks, "id", "n", F.struct("doc", "line")).filter("rank is not null").select("doc", "doc_id", "line", "rank", "first"), total


def _longer(ranked: DataFrame, step: int, total: int) -> DataFrame:
    """Ranks at a length greater by ``step`` (at most the length so far): pairs of ranks that occur twice or more."""
    after = ranked.select("doc", (F.col("line") - step).alias("line"), F.col("rank").alias("then"))
    pairs = staged(ranked.drop("first").join(after, ["doc", "line"]).select("doc", "doc_id", "line", F.struct("rank", "then").alias("pair")))
    counts = pairs.groupBy("pair").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "doc", "line")).alias("first")).filter("n > 1").select("pair", "pair.rank", "pair.then", "n", "first")
    # in the order of ``then``; a line that very many others follow is summed in ranges of it
    placed = prefix_sums(counts, ["rank"], ["then"], F.col("n"), "before", bucket=F.floor(F.col("then") / max(1, total // RANGES)))
    ranks = staged(placed.select("pair", (F.col("rank") + F.col("before")).alias("new"), "first", "n"))
    found = attach(pairs, ranks, "pair", "n", F.struct("doc", "line"))
    return found.filter("new is not null").select("doc", "doc_id", "line", F.col("new").alias("rank"), "first")


def later_copies(docs: DataFrame, least: int) -> DataFrame:
    """(doc, line, depth) for ``docs`` (doc, doc_id, text): the places where a later copy of ``depth`` lines begins, ``depth`` being the
    length of the deepest interval with an earlier place (smaller doc_id, then doc and line) in it; ``least`` at least."""
    ranked, total = _first_ranks(_lines(docs))
    ranked, length = staged(ranked), 1
    while 2 * length <= least:
        ranked, length = staged(_longer(ranked, length, total)), 2 * length
    if length < least:
        ranked, length = staged(_longer(ranked, least - length, total)), least
    levels = []
    while True:
        later = ranked.filter(~F.col("first").eqNullSafe(F.struct("doc_id", "doc", "line")))
        levels.append(later.select("doc", "line", F.lit(length).alias("depth")))
        if ranked.isEmpty():
            break
        ranked, length = staged(_longer(ranked, length, total)), 2 * length
    return reduce(DataFrame.unionByName, levels).groupBy("doc", "line").agg(F.max("depth").alias("depth"))


_RUNS = "array<struct<from_line: int, to_line: int>>"


def repeated_runs(docs: DataFrame, least: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, depth, runs, kept_text.

    A line goes if a run of ``least`` lines or more that covers it also starts at an earlier place (smaller doc_id, then line;
    documents of one id by a hash). Lines end at "\\n" and are compared as they are, blank ones too. ``runs``: the maximal repeated
    runs removed, as ranges of lines. ``depth``: the longest doubling of ``least`` lines that is a later copy, else 0. Null texts
    have no lines and stay null; an empty text has one empty line. Rows that repeat id and text are one document.
    Columns of other names are not looked at.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("doc", F.xxhash64("doc_id", "text"))
    copies = later_copies(given, least)
    found = staged(copies.groupBy("doc").agg(F.max("depth").alias("depth"), F.array_sort(F.collect_list(F.struct("line", "depth"))).alias("copies")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("from_line", pa.int32()), ("to_line", pa.int32())]))
        for batch in batches:
            counts, removed, spans, kept = [], [], [], []
            for text, copies in zip(batch.column("text"), batch.column("copies"), strict=True):
                if not text.is_valid:
                    counts.append(0), removed.append(0), spans.append([]), kept.append(None)
                    continue
                lines, runs = text.as_py().split("\n"), []
                for at, depth in ((c["line"], c["depth"]) for c in copies.as_py() or []):
                    if runs and at <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], at + depth)
                    else:
                        runs.append([at, at + depth])
                edges = [0, *(x for r in runs for x in r), len(lines)]
                counts.append(len(lines)), removed.append(sum(b - a for a, b in runs)), spans.append([{"from_line": a, "to_line": b} for a, b in runs])
                kept.append("\n".join(x for a, b in zip(edges[::2], edges[1::2], strict=True) for x in lines[a:b]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), batch.column("depth"), pa.array(spans, kind), pa.array(kept, pa.string())],
                ["doc_id", "n_lines", "n_removed", "depth", "runs", "kept_text"],
            )

    # merged at every size: a broadcast that only small inputs allow would hide what the join moves on large ones
    joined = given.join(found.hint("merge"), "doc", "left").select("doc_id", "text", "copies", F.coalesce("depth", F.lit(0)).alias("depth"))
    return joined.mapInArrow(work, f"doc_id long, n_lines long, n_removed long, depth int, runs {_RUNS}, kept_text string")
