"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted lists, distance-weighted votes.

Terms are lower-case words of letters and their beginnings of PREFIX letters, so forms of one stem meet. Every term of the examples is
in the index. A term weighs its count's logarithm, times its inverse document frequency over all documents, times how much
it tells about the label: from FLOOR for one that goes with no label to 1. Terms that no example has are left out of a text's vector.
A vote weighs the cosine squared, times how many labelled rows its class has for each example drawn, so that scores keep to the
share of toxic rows although the examples of both classes are about as many.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.words import NO_LETTER, Words, pieces
from loomgraph.plans.shared import cut

#: The bound of what is learnt from and broadcast: labelled examples of each class. Scoring and document frequencies have none.
EXAMPLES_A_CLASS = 1500
BLOCK, NEIGHBOURS, PREFIX = 64, 25, 5
#: The longest lists, at most so many, are kept as columns, if an example in THIN has the term; so many texts are looked at together.
LONG, THIN, QUERIES = 512, 32, 256
#: A term tells all about the label at this difference in standard errors and these log odds; at the first number of errors it begins to tell.
FLOOR, FEW_ERRORS, MANY_ERRORS, MUCH_ODDS = 0.15, 2.5, 8.5, 3.0
#: Half a vote's worth of the prior, for texts with distant neighbours only.
PRIOR_WEIGHT = 0.05
_BEGINNING = np.uint64(0xC2B2AE3D27D4EB4F)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each range, one after the other."""
    done = np.cumsum(length)
    return np.repeat(start - (done - length), length) + np.arange(done[-1] if len(done) else 0)


def term_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word and of each longer word's first PREFIX letters."""
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    letter = np.append(np.flatnonzero((words.data & 0xC0) != 0x80), len(words.data))  # where characters begin
    stop = letter[np.minimum(np.searchsorted(letter, words.start) + PREFIX, len(letter) - 1)]
    longer = stop < words.end
    return np.concatenate([row, row[longer]]), np.concatenate([words.hash, words.ranges(words.start[longer], stop[longer]) ^ _BEGINNING])


def counted(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, row, hash) of the terms of runs of rows."""
    for low, high, words in pieces(pc.utf8_lower(column), between=NO_LETTER):
        yield low, high, *term_hashes(words)


def bag(row: np.ndarray, term: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, term, count): row i has the distinct terms first[i] to first[i + 1], in order."""
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])]) if len(row) else np.zeros(0, np.int64)
    return np.searchsorted(row[new], np.arange(rows + 1)), term[new], np.diff(np.r_[new, len(row)])


@dataclass
class Vocabulary:
    """Sorted hashes of terms; those with the same first bits lie from first[bits] to first[bits + 1]."""

    hashes: np.ndarray

    @cached_property
    def first(self) -> tuple[np.uint64, np.ndarray]:
        bits = len(self.hashes).bit_length() + 1
        shift = np.uint64(64 - bits)
        return shift, np.searchsorted(self.hashes >> shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def bag(self, row: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, term, count) as of ``bag``, with the numbers of the terms that are known."""
        shift, first = self.first
        bits = hashes >> shift
        at, end = first[bits], first[bits + np.uint64(1)]
        left, keys = np.flatnonzero(at < end), []
        while len(left):
            own = at[left]
            hit = self.hashes[own] == hashes[left]
            keys.append(row[left[hit]] * len(self.hashes) + own[hit])
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < end[left]]
        key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        own, term = np.divmod(key[new], max(len(self.hashes), 1))
        return np.searchsorted(own, np.arange(rows + 1)), term, np.diff(np.r_[new, len(key)])


@dataclass
class BlockMaxIndex:
    """Inverted lists of unit vectors over blocks of BLOCK consecutive examples. List t has the entries entry[t] to entry[t + 1], one for each
    block with the term, with the largest weight there; entry e has the postings posting[e] to posting[e + 1]."""

    vocabulary: np.ndarray
    weight: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    votes: np.ndarray
    prior: float
    entry: np.ndarray
    block: np.ndarray
    most: np.ndarray
    posting: np.ndarray
    place: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, vocabulary: np.ndarray, weight: np.ndarray, first: np.ndarray, term: np.ndarray, count: np.ndarray, labels: np.ndarray, ids: np.ndarray, votes: np.ndarray, prior: float) -> BlockMaxIndex:
        """``first``, ``term`` (numbers in the vocabulary) and ``count``: the examples' bags."""
        n = len(labels)
        row = np.repeat(np.arange(n), np.diff(first))
        value = (1 + np.log(np.maximum(count, 1))) * weight[term]
        norm = np.sqrt(np.bincount(row, value**2, minlength=n))
        # examples of one language, and of about one length, share blocks: their lists begin with the same frequent term
        frequent = np.full(n, len(vocabulary))
        np.minimum.at(frequent, row, np.argsort(np.argsort(-np.bincount(term, minlength=len(vocabulary)), kind="stable"))[term])
        order = np.lexsort((ids, norm, frequent))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        by = np.lexsort((place[row], term))
        term, at, value = term[by], place[row][by], (value / np.maximum(norm, 1e-12)[row])[by].astype(np.float32)
        new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (at[1:] // BLOCK != at[:-1] // BLOCK)]) if len(term) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(value, new) if len(new) else value
        return cls(
            vocabulary, weight, labels[order], ids[order], votes[order], prior, np.searchsorted(term[new], np.arange(len(vocabulary) + 1)), at[new] // BLOCK, most,
            np.append(new, len(term)), at, value,
        )

    @cached_property
    def known(self) -> Vocabulary:
        return Vocabulary(self.vocabulary)

    @cached_property
    def long(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(column of each term or -1; weights by example and column; largest weights by column and block) of the longest lists. Most
        examples have most of these terms, so a block is opened for them by a product of matrices."""
        n, blocks = len(self.labels), -(-len(self.labels) // BLOCK)
        sizes = np.diff(self.posting[self.entry])
        chosen = np.argsort(-sizes, kind="stable")[:LONG]
        chosen = np.sort(chosen[sizes[chosen] * THIN >= n])
        column = np.full(len(sizes), -1)
        column[chosen] = np.arange(len(chosen))
        table, most = np.zeros((n, len(chosen)), np.float32), np.zeros((len(chosen), blocks), np.float32)
        at = _ranges(self.posting[self.entry[chosen]], sizes[chosen])
        table[self.place[at], np.repeat(column[chosen], sizes[chosen])] = self.value[at]
        entries = np.diff(self.entry)[chosen]
        at = _ranges(self.entry[chosen], entries)
        most[np.repeat(column[chosen], entries), self.block[at]] = self.most[at]
        return column, table, most

    def vectors(self, row: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, term, value): the unit vectors of texts over known terms."""
        first, term, count = self.known.bag(row, hashes, rows)
        value = (1 + np.log(np.maximum(count, 1))) * self.weight[term]
        own = np.repeat(np.arange(rows), np.diff(first))
        norm = np.sqrt(np.bincount(own, value**2, minlength=rows))
        return first, term, value / np.maximum(norm, 1e-12)[own]

    def nearest(self, term: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``nearest_each`` of one query."""
        return next(self.nearest_each(np.array([0, len(term)]), term, value, k))

    def nearest_each(self, first: np.ndarray, term: np.ndarray, value: np.ndarray, k: int = NEIGHBOURS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, cosines) of the k examples of the largest cosine over 0, for each query; exact, ties by place.

        Short lists are read as they are. The blocks of the largest bounds (the most that short lists gave there, and the largest weights of long ones)
        are opened first, then all whose bound reaches the k-th cosine found there. Cosines are first told in single precision;
        what may be among the k by its error bound is then told in double precision."""
        for low in range(0, len(first) - 1, QUERIES):
            yield from self._nearest(first[low : low + QUERIES + 1], term, value, k)

    def _nearest(self, first: np.ndarray, term: np.ndarray, value: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows, n, blocks = len(first) - 1, len(self.labels), -(-len(self.labels) // BLOCK)
        if not n:
            yield from [(np.zeros(0, np.int64), np.zeros(0))] * rows
            return
        lists, (column, table, most) = self.posting[self.entry], self.long
        term, value, first = term[first[0] : first[-1]], value[first[0] : first[-1]], first - first[0]
        own, at = np.repeat(np.arange(rows), np.diff(first)), column[term]
        query = np.zeros((rows, table.shape[1]), np.float32)
        query[own[at >= 0], at[at >= 0]] = value[at >= 0]
        sums = np.zeros((rows, n))
        for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            short = at[a:b] < 0
            begin = lists[term[a:b][short]]
            size = lists[term[a:b][short] + 1] - begin
            posting = _ranges(begin, size)
            sums[i] = np.bincount(self.place[posting], np.repeat(value[a:b][short], size) * self.value[posting], minlength=n)
        cosine = sums.astype(np.float32)
        bound = query @ most + np.maximum.reduceat(cosine, np.arange(0, n, BLOCK), axis=1)
        # twice what rounding may do to a sum of so many products, whose absolute values add up to at most the query's length
        slack = (2 * (table.shape[1] + 8) * 2.0**-24 * np.sqrt(np.bincount(own, value**2, minlength=rows)))[:, None]

        def opened(chosen: np.ndarray) -> None:
            for block in np.flatnonzero(chosen.any(axis=0)):
                some, inside = np.flatnonzero(chosen[:, block]), slice(block * BLOCK, (block + 1) * BLOCK)
                cosine[some, inside] += query[some] @ table[inside].T

        def least() -> np.ndarray:
            return np.partition(cosine, n - k, axis=1)[:, n - k, None] if n > k else np.zeros((rows, 1), np.float32)

        few = min(blocks, 2 + -(-k // BLOCK))
        best = np.zeros((rows, blocks), bool)
        np.put_along_axis(best, np.argpartition(-bound, few - 1, axis=1)[:, :few], True, axis=1)
        opened(best)
        opened(~best & (bound > 0) & (bound >= least() - slack))
        near = (cosine > 0) & (cosine >= least() - slack)
        for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            long = at[a:b] >= 0
            found = np.flatnonzero(near[i])
            exact = sums[i, found] + (table[found[:, None], at[a:b][long]] * value[a:b][long]).sum(axis=1)
            order = np.lexsort((found, -exact))[:k]
            yield found[order], exact[order]

    def scores(self, first: np.ndarray, term: np.ndarray, value: np.ndarray, k: int = NEIGHBOURS) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """(score from 0 to 1, places, cosines) of each query; without neighbours the prior."""
        out = []
        for near, cosine in self.nearest_each(first, term, value, k):
            weight = cosine**2 * self.votes[near]
            score = float((weight @ self.labels[near] + PRIOR_WEIGHT * self.prior) / (weight.sum() + PRIOR_WEIGHT))
            out.append((score if len(near) else self.prior, near, cosine))
        return out


def _examples(docs: DataFrame, known: DataFrame, each: int) -> DataFrame:
    """Up to ``each`` labelled texts of each class, by a hash; of texts with one smallest shingle hash (copies, most near copies) one.

    Twice as many ids are drawn from the labels first, so that only their texts are looked at; ids are few enough to broadcast.
    """
    drawn = [known.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * each) for k in (0, 1)]
    near = docs.join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id").withColumn("words", F.split(F.lower("text"), r"\s+")).select(
        "label", "doc_id", F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - 2)), lambda i: F.xxhash64(F.slice("words", i, 3)))).alias("shingle")
    )
    one = cut(near.groupBy("label", "shingle").agg(F.min_by("doc_id", F.struct(F.xxhash64("doc_id"), "doc_id")).alias("doc_id")))
    chosen = [one.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for k in (0, 1)]
    found = docs.join(F.broadcast(chosen[0].unionByName(chosen[1]).select("label", "doc_id")), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, row, term in counted(batch.column("text")):
            first, term, count = bag(row, term, high - low)
            lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(x)) for x in (term.view(np.int64), count.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:high], batch.column("label")[low:high], *lists], ["doc_id", "label", "terms", "counts"])


def _frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many of them have each term of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = shared.value, 0
        seen = np.zeros(len(known.hashes), np.int64)
        for batch in batches:
            total += batch.num_rows
            for low, high, row, hashes in counted(batch.column("text")):
                seen += np.bincount(known.bag(row, hashes, high - low)[1], minlength=len(seen))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(seen[some], total))], ["i", "n"])

    sums = docs.select("text").mapInArrow(work, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    at, n = sums["i"].to_numpy(), sums["n"].to_numpy()
    out = np.zeros(len(vocabulary) + 1, np.int64)
    out[at] = n  # the last is the number of documents
    return int(out[-1]), out[:-1]


def fit(docs: DataFrame, known: DataFrame, each: int = EXAMPLES_A_CLASS, learn_from: DataFrame | None = None) -> BlockMaxIndex:
    """An index over a bounded sample of ``learn_from`` (doc_id, text; ``docs`` by default) by ``known`` (doc_id, label), with document frequencies over all
    of ``docs``. Rows with a null label, id or text are not learnt from; of labels that contradict each other for one id the larger counts, of
    texts the smallest. Without labels of both classes nothing is learnt, and every text scores 0.5."""
    known = known.filter("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    classes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not (classes.get(0) and classes.get(1)):
        none = np.zeros(0, np.int64)
        return BlockMaxIndex.build(np.zeros(0, np.uint64), np.zeros(0), np.zeros(1, np.int64), none, none, none, none, np.zeros(0), 0.5)
    chosen = _examples((docs if learn_from is None else learn_from).filter("text is not null").select("doc_id", "text"), known, each)
    bags = chosen.select("doc_id", "label", "text").mapInArrow(_bags, "doc_id long, label long, terms array<bigint>, counts array<int>").toArrow().sort_by([("doc_id", "ascending")])
    labels, ids = bags["label"].to_numpy(), bags["doc_id"].to_numpy()
    sizes = pc.list_value_length(bags["terms"]).to_numpy()
    hashes, counts = (pc.list_flatten(bags[c]).to_numpy() for c in ("terms", "counts"))
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    vocabulary, term = np.unique(hashes.view(np.uint64), return_inverse=True)
    n = [max(1, int((labels == k).sum())) for k in (0, 1)]
    prior = (classes.get(1, 0) + 0.5) / (sum(classes.values()) + 1)
    votes = np.where(labels == 1, classes.get(1, 0) / n[1], classes.get(0, 0) / n[0])
    if not len(vocabulary):
        return BlockMaxIndex.build(vocabulary, np.zeros(0), first, term, counts, labels, ids, votes, prior)
    toxic = np.bincount(term, np.repeat(labels, sizes), minlength=len(vocabulary))
    clean = np.bincount(term, minlength=len(vocabulary)) - toxic
    share = (toxic + clean) / len(labels)
    errors = np.abs(toxic / n[1] - clean / n[0]) / np.sqrt(np.maximum(share * (1 - share) * (1 / n[0] + 1 / n[1]), 1e-12))
    odds = np.abs(np.log(((toxic + 0.5) / (n[1] + 1)) / ((clean + 0.5) / (n[0] + 1))))
    tells = np.clip((errors - FEW_ERRORS) / (MANY_ERRORS - FEW_ERRORS), 0, 1) * np.minimum(odds / MUCH_ODDS, 1)
    total, frequency = _frequencies(docs, vocabulary)
    weight = np.log((2 + total) / (1 + frequency)) * np.maximum(FLOOR, tells)
    return BlockMaxIndex.build(vocabulary, weight, first, term, counts, labels, ids, votes, prior)


def score(docs: DataFrame, index: BlockMaxIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score, evidence (example id, cosine, label; the nearest first). Texts that are null, empty or without a
    known term get the prior and no evidence. Equal texts get equal rows. An empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    fields = [("example", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for low, high, row, hashes in counted(batch.column("text")):
                found = known.scores(*known.vectors(row, hashes, high - low))
                near, cosine = (np.concatenate([f[k] for f in found]) for k in (1, 2))
                struct = pa.StructArray.from_arrays([pa.array(known.ids[near.astype(np.int64)], pa.int64()), pa.array(np.round(cosine, 6)), pa.array(known.labels[near.astype(np.int64)].astype(np.int32))], fields=[pa.field(*f) for f in fields])
                evidence = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(f[1]) for f in found])]).astype(np.int32)), struct)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[low:high], pa.array([f[0] for f in found], pa.float64()), evidence], ["doc_id", "score", "evidence"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(scored, "doc_id long, score double, evidence array<struct<example: bigint, cosine: double, label: int>>")


def held_out(id_col: str = "doc_id", modulus: int = 3, remainder: int = 1):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder


def _known(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.col("toxic").cast("long").alias("label")).filter(~held_out())


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, learn_from: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, evidence.

    Learns from the texts of ``learn_from`` (``docs`` by default) whose ``labels.toxic`` is given and that are not held out. Without
    labels of both classes all scores are 0.5. Columns of other names are not looked at.
    """
    index = fit(docs.select("doc_id", "text"), _known(labels), learn_from=learn_from)
    return score(docs, index).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns. Null and empty texts score the prior; all rows stay without labels of both classes."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), _known(labels)))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [found[0] < threshold for known in [shared.value] for low, high, row, hashes in counted(batch.column("text")) for found in known.scores(*known.vectors(row, hashes, high - low))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
