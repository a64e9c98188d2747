"""Audit of how far apart sources are in their words: exact divergences of every two sources of a language by count-level bitmaps.

A kept term has a number in its language, terms of about one frequency next to each other. For each group (language, source) and count, a
bitset says which terms have that count there; it is stored in chunks of CHUNK numbers, and a chunk holds few counts as its terms are about as
frequent. For two groups, AND and popcount of two bitsets give how many terms have this count in one and that in the other; times
f, summed over the counts, this is their divergence. Terms that a group lacks are the complement of all its bitsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.words import NO_LETTER, pieces
from loomgraph.plans.shared import prefix_sums, staged

#: Numbers of a chunk, bits of a word, and sources that meet in one task.
CHUNK, WORD, BLOCK = 256, 64, 64
LEAST_DOCS, TOP = 30, 50
ONE, ADDED = 1_000_000_000, 5
#: Rows that are counted at once hold about so many bytes of text.
BYTES = 1 << 23


def _encoded(words, rows: int) -> tuple[np.ndarray, pa.Array]:
    """(code of each word, the distinct words): exact, as the words' own bytes are compared."""
    flat = words.data[~NO_LETTER[words.data]]  # words are all runs of such bytes
    ends = np.concatenate([[0], np.cumsum(words.end - words.start)]).astype(np.int64)
    text = pa.Array.from_buffers(pa.large_binary(), len(words.start), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
    found = text.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For runs of rows (lang, source, text): the count of each term in each group and in how many rows it is."""
    for batch in batches:
        groups = batch.select(["lang", "source"])
        pair = pa.StructArray.from_arrays(groups.columns, names=["lang", "source"])
        keys = pc.binary_join_element_wise(pc.cast(pc.binary_length(groups.column(0)), pa.string()), groups.column(0), groups.column(1), ":").dictionary_encode()
        first = np.unique(keys.indices.to_numpy(), return_index=True)[1]
        group_of = keys.indices.to_numpy().astype(np.int64)
        for low, high, words in pieces(batch.column("text"), hashed=False, lower=True, between=NO_LETTER, size=BYTES):
            if not len(words.start):
                continue
            code, terms = _encoded(words, high - low)
            row = np.repeat(np.arange(low, high), np.diff(words.first))
            in_row, times = np.unique(row * len(terms) + code, return_counts=True)
            group = group_of[in_row // len(terms)] * len(terms) + in_row % len(terms)
            cell, at = np.unique(group, return_inverse=True)
            own = pair.take(pa.array(first[cell // len(terms)]))
            yield pa.RecordBatch.from_arrays(
                [own.field(0), own.field(1), terms.take(pa.array(cell % len(terms))).cast(pa.large_string()).cast(pa.string()), pa.array(np.bincount(at, times).astype(np.int64)), pa.array(np.bincount(at))],
                ["lang", "source", "term", "n", "docs"],
            )


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of (lang, source, text) without nulls."""
    partial = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def smoothed(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 5) / (total + 5 * terms)), exact; null where there is no term."""
    wide = lambda c: c.cast("decimal(20,0)")
    return 1 + F.call_function("div", wide(count + ADDED) * F.lit(ONE).cast("decimal(10,0)"), wide(total + ADDED * terms)).cast("long")


def _kernel(rows: pa.Table) -> pa.Table:
    """(lang, a, b, value): for the rows of a chunk of one language that two blocks of sources meet in. A row is a level of a source: its p and bits; a
    source's level of no occurrence has all bits of the chunk, less those of its other levels."""
    source = rows.column("source").combine_chunks().dictionary_encode()
    s, names = source.indices.to_numpy(), source.dictionary
    bits = np.column_stack([rows.column(c).to_numpy() for c in rows.column_names if c[0] == "w"]).view(np.uint64)
    zero, p, block = rows.column("zero").to_numpy(), rows.column("p").to_numpy(), rows.column("block").to_numpy()
    held = np.zeros((len(names), bits.shape[1]), np.uint64)
    np.bitwise_or.at(held, s[~zero], bits[~zero])
    bits[zero] &= ~held[s[zero]]
    order = np.argsort(s, kind="stable")
    s, bits, p, block = s[order], bits[order], p[order], block[order]
    edge = np.searchsorted(s, np.arange(len(names) + 1))
    rank = np.empty(len(names), np.int64)
    rank[pc.sort_indices(names.cast(pa.binary())).to_numpy()] = np.arange(len(names))
    own, within = block[edge[:-1]], rows.column("low")[0] == rows.column("high")[0]
    a, b, value = [], [], []
    for i in range(len(names)):
        levels = slice(edge[i], edge[i + 1])
        total = np.zeros(len(s), np.int64)
        for one, q in zip(bits[levels], p[levels], strict=True):
            total += np.bitwise_count(bits & one).sum(axis=1, dtype=np.int64) * np.abs(p - q)
        each = np.add.reduceat(total, edge[:-1])
        # each two sources meet once: in the pair of their blocks
        for j in np.flatnonzero(rank > rank[i]):
            if within or own[i] != own[j]:
                a.append(i), b.append(j), value.append(each[j])
    at = lambda k: names.take(pa.array(k, pa.int32()))
    return pa.table([pa.array([rows.column("lang")[0].as_py()] * len(a), pa.string()), at(a), at(b), pa.array(value, pa.int64())], names=["lang", "a", "b", "value"])


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) for each group (lang, source) that occurs.

    Part ``pair``: every other source of the language, by the sum over its kept terms (in at least ``least_docs`` of its documents) of the differences
    of the groups' p. Part ``term``: up to ``top`` terms that the group has and whose p is above the language's, by the difference. Null texts, languages and
    sources count as empty strings; a language without kept terms has pairs of value 0 and no terms, and a source that is alone in its
    language no pairs. Repeated rows count each. An empty table gives no rows. Other columns are not looked at, whatever their names.
    Equal values rank by item.
    """
    given = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = staged(term_counts(given))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term", "in_lang")
    # more frequent terms first, so that a chunk's terms have few counts; within a frequency by a hash
    level = 4096 - F.floor(F.log2("in_lang") * 16)
    kept = staged(kept.withColumn("level", level * 1024 + F.pmod(F.xxhash64("term"), F.lit(1024))))
    kept = staged(prefix_sums(kept, ["lang"], ["term"], F.lit(1), "id", bucket=F.col("level")).select("lang", "term", "in_lang", "id"))
    cells = staged(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))

    # small tables: a row for each group, for each language
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"))
    groups = given.select("lang", "source").distinct().join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = staged(groups.na.fill(0, ["total", "terms", "lang_total"]))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    groups = groups.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int"))

    # bitsets: a row for each level of a group in a chunk
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") % WORD).cast("int"))
    words = [F.coalesce(F.bit_or(F.when(F.floor(F.col("id") % CHUNK / WORD) == k, bit)), F.lit(0).cast("long")).alias(f"w{k}") for k in range(CHUNK // WORD)]
    levels = cells.withColumn("chunk", F.floor(F.col("id") / CHUNK)).groupBy("lang", "source", "chunk", "n").agg(*words).join(groups, ["lang", "source"])
    levels = levels.select("lang", "chunk", "source", "block", "blocks", F.lit(False).alias("zero"), smoothed(F.col("n"), F.col("total"), F.col("terms")).alias("p"), *[f"w{k}" for k in range(CHUNK // WORD)])
    chunks = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("terms") + CHUNK - 1) / CHUNK) - 1, F.lit(0).cast("long")))))
    size = lambda k: F.least(F.greatest(F.col("terms") - F.col("chunk") * CHUNK - k * WORD, F.lit(0)), F.lit(WORD)).cast("int")
    full = [F.when(size(k) == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), WORD - size(k))).alias(f"w{k}") for k in range(CHUNK // WORD)]
    nothing = chunks.select("lang", "chunk", "source", "block", "blocks", F.lit(True).alias("zero"), F.when(F.col("terms") > 0, smoothed(F.lit(0).cast("long"), F.col("total"), F.col("terms"))).otherwise(0).alias("p"), *full)
    # a source's rows go to each pair of its block with another
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = levels.unionByName(nothing).withColumn("other", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "blocks")
    partial = dealt.groupBy("lang", "chunk", "low", "high").applyInArrow(_kernel, "lang string, a string, b string, value long")
    found = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = found.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    p, q = smoothed(F.col("n"), F.col("total"), F.col("terms")), smoothed(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
    terms = cells.join(groups, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top))
