"""Chroma fingerprints of audio columns, and alignment of recordings by offset histograms and bit errors.

A recording is 8-bit unsigned PCM. Frames of its spectrum are folded into twelve pitch classes; sixteen rectangle
filters over sixteen frames, read off an integral image, give two Gray-coded bits each, packed into one 32-bit item a frame.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.shared import cut, stage, staged

#: Frames of one item.
SPAN = 16
#: The middle value of 8-bit PCM.
SILENCE = 128
#: An offset is looked at if so many distinct pairs of consecutive items vote for it; a passage there is aligned if so many
#: distinct items are equal in it (twice as many if it's less than WHOLE of the overlap) and at most so many bits are wrong.
LEAST_VOTES, LEAST_EQUAL, WHOLE, MOST_ERRORS = 3, 6, 0.9, 0.25
#: Items of queries that one broadcast holds; a query set is searched for in blocks of this size, a job each.
QUERY_ITEMS = 1 << 22
#: Combinations of places of pairs that are listed at once; a pair with more is correlated. Places of a pair from which on they are taken by themselves, and
#: items of overlaps that are looked at together.
_CELLS, _MANY, _OVERLAPS = 1 << 20, 128, 1 << 17
#: Frames whose spectra are held at once, and frames of short recordings that are worked on together.
_FRAMES, _TOGETHER = 1 << 14, 1 << 11
#: Items that one task asks for, more or less: their files are small, and a task would hold a great many of them.
_EACH = 1 << 19
#: Passages, or a few more, that are handed on together.
_TOLD = 1 << 14
_ALLOWED = int(32 * MOST_ERRORS)


class Form(NamedTuple):
    """Samples a second, samples of a frame, and samples from one frame to the next."""

    rate: int
    frame: int
    hop: int

    @property
    def least(self) -> int:
        """Samples that the first item takes; a shorter recording has no item."""
        return self.frame + (SPAN - 1) * self.hop


#: For music, whose semitones need long frames; and for short sounds, such as texts read as sound.
MUSIC, SHORT = Form(11025, 4096, 1365), Form(8000, 128, 32)


@lru_cache
def _tables(form: Form) -> tuple[np.ndarray, np.ndarray]:
    """The window, and the pitch class of each bin of the spectrum (the constant part has none)."""
    bins = np.arange(1, form.frame // 2 + 1)
    note = np.round(12 * np.log2(bins * form.rate / form.frame / 440)).astype(int) % 12
    fold = np.zeros((form.frame // 2 + 1, 12))
    fold[bins, note] = 1
    return np.hanning(form.frame), fold


#: (kind, lowest class, classes, frames) of the filters: kinds alternate, places and sizes go round.
FILTERS = [(k % 4, (5 * k) % 8, 2 + 2 * (k % 2), 4 + 4 * (k % 4)) for k in range(16)]
EDGE = 0.1
#: Where the logarithm of a filter's value has its edges.
_EDGES = np.exp([-EDGE, 0.0, EDGE])


def chroma(waves: np.ndarray, form: Form = MUSIC) -> np.ndarray:
    """Recordings by frames by twelve classes, each frame of length one (silent frames are zero), of recordings by samples."""
    window, fold = _tables(form)
    frames = np.lib.stride_tricks.sliding_window_view(waves.astype(np.float64) - SILENCE, form.frame, axis=1)[:, :: form.hop]
    energy = np.concatenate([np.abs(np.fft.rfft(frames[:, i : i + _FRAMES] * window, axis=2)) ** 2 @ fold for i in range(0, frames.shape[1], _FRAMES)], axis=1)
    norm = np.sqrt((energy**2).sum(axis=2, keepdims=True))
    return np.divide(energy, norm, out=np.zeros_like(energy), where=norm > 1e-6)


def _items(waves: np.ndarray, form: Form) -> np.ndarray:
    """Recordings by items."""
    image = chroma(waves, form)
    total = np.zeros((13, image.shape[0], image.shape[1] + 1))  # a plane for each class
    total[1:, :, 1:] = np.moveaxis(image.cumsum(axis=1).cumsum(axis=2), 2, 0)
    n = image.shape[1] - SPAN + 1

    def box(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return total[c1, :, t1 : t1 + n] - total[c1, :, t0 : t0 + n] - total[c0, :, t1 : t1 + n] + total[c0, :, t0 : t0 + n]

    items = np.zeros((len(waves), n), np.uint32)
    for kind, low, tall, wide in FILTERS:
        high, half, mid = low + tall, low + tall // 2, wide // 2
        if kind == 0:  # against the classes left
            a, b = box(0, wide, low, high), box(0, wide, 0, 12) / 3
        elif kind == 1:  # low against high classes
            a, b = box(0, wide, low, half), box(0, wide, half, high)
        elif kind == 2:  # early against late frames
            a, b = box(0, mid, low, high), box(mid, wide, low, high)
        else:  # both, as a chequerboard
            a, b = box(0, mid, low, half) + box(mid, wide, half, high), box(0, mid, half, high) + box(mid, wide, low, half)
        value = (1 + a) / (1 + b)
        level = sum((value >= edge).astype(np.uint32) for edge in _EDGES)
        items = items << np.uint32(2) | (level ^ level >> np.uint32(1))
    return items


def fingerprints(recordings: list[bytes | pa.Buffer | None], form: Form = MUSIC) -> list[np.ndarray]:
    """Each recording's items. Recordings are worked on together with those of about their length, as most of the time for a short one goes to
    calls; what is added behind the shorter ones is not looked at."""
    found = [np.zeros(0, np.uint32)] * len(recordings)
    frames = {k: (len(x) - form.frame) // form.hop + 1 for k, x in enumerate(recordings) if x and len(x) >= form.least}
    groups: list[list[int]] = []
    for k in sorted(frames, key=frames.__getitem__):
        if not groups or (len(groups[-1]) + 1) * frames[k] > _TOGETHER:
            groups.append([])
        groups[-1].append(k)
    for group in groups:
        size = form.frame + (frames[group[-1]] - 1) * form.hop
        waves = np.full((len(group), size), SILENCE, np.uint8)
        for row, k in zip(waves, group, strict=True):
            data = np.frombuffer(recordings[k], np.uint8)[:size]
            row[: len(data)] = data
        for row, k in zip(_items(waves, form), group, strict=True):
            found[k] = row[: frames[k] - SPAN + 1].copy()
    return found


def fingerprint(data: bytes | None, form: Form = MUSIC) -> np.ndarray:
    """One unsigned 32-bit item for each SPAN consecutive frames; none for less data than that."""
    return fingerprints([data], form)[0]


class Passage(NamedTuple):
    """Items low to high of a recording, alike to those of a query that lie ``offset`` before."""

    low: int
    high: int
    offset: int
    equal: int
    errors: float


def passages(mine: np.ndarray, theirs: np.ndarray, offset: int) -> list[Passage]:
    """All passages at one offset: runs whose allowed less wrong bits sum to the most, then those beside them, with enough distinct equal items each."""
    skip = max(0, offset)
    a, b = mine[skip:], theirs[max(0, -offset) :]
    n = min(len(a), len(b))
    wrong = np.bitwise_count(a[:n] ^ b[:n]).astype(np.int64)
    same = wrong == 0
    gain = np.concatenate([[0], np.cumsum(_ALLOWED - wrong)])
    found, left = [], [(0, n)]
    while left:
        low, high = left.pop()
        if np.count_nonzero(same[low:high]) < LEAST_EQUAL * (1 if high - low >= WHOLE * n else 2):
            continue  # no run in it has enough
        part = gain[low : high + 1]
        end = int((part - np.minimum.accumulate(part)).argmax())
        start, end = low + int(part[: end + 1].argmin()), low + end
        if end == start:
            continue  # else a run beside this one gains less, but may hold more equal items
        equal = a[start:end][same[start:end]]
        distinct = len(set(equal.tolist())) if len(equal) >= LEAST_EQUAL else 0
        if distinct >= LEAST_EQUAL * (1 if end - start >= WHOLE * n else 2):
            errors = round(float(wrong[start:end].sum()) / (32 * (end - start)), 6)
            found.append(Passage(skip + start, skip + end, offset, distinct, errors))
        left += [(x, y) for x, y in ((low, start), (end, high)) if y - x >= LEAST_EQUAL]
    return found


def _pairs(items: np.ndarray) -> np.ndarray:
    """Each two consecutive items as one number. Single items are too common: most of their places are chance ones."""
    return items[:-1].astype(np.uint64) << np.uint64(32) | items[1:]


def _fresh(told: np.ndarray) -> np.ndarray:
    """Which entries are not equal to the one before."""
    found = np.ones(len(told), bool)
    np.not_equal(told[1:], told[:-1], out=found[1:])
    return found


class Places(NamedTuple):
    """Distinct pairs of consecutive items of a recording; those of pair k are at order[first[k] : first[k] + count[k]]."""

    pair: np.ndarray
    order: np.ndarray
    first: np.ndarray
    count: np.ndarray
    n_items: int


def places(items: np.ndarray) -> Places:
    pairs = _pairs(items)
    order = np.argsort(pairs, kind="stable")
    pair, first, count = np.unique(pairs[order], return_index=True, return_counts=True)
    return Places(pair, order, first, count, len(items))


def _listed(mine: np.ndarray, at_a: np.ndarray, n_a: np.ndarray, theirs: np.ndarray, at_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the pair, offset), each once: all combinations of n_a places from at_a in ``mine`` and n_b from at_b in ``theirs``."""
    work = n_a * n_b
    if (work == 1).all():
        return np.arange(len(work)), mine[at_a] - theirs[at_b]
    pair = np.repeat(np.arange(len(work)), work)
    within = np.arange(len(pair)) - np.repeat(np.cumsum(work) - work, work)
    offset = mine[at_a[pair] + within // n_b[pair]] - theirs[at_b[pair] + within % n_b[pair]]
    low = offset.min()
    width = offset.max() - low + 1
    cell = np.sort(pair * width + offset - low)
    cell = cell[np.concatenate([[True], cell[1:] != cell[:-1]])]
    return cell // width, cell % width + low


def alike_offsets(mine: Places, theirs: Places, i: np.ndarray, j: np.ndarray) -> list[int]:
    """Offsets at which LEAST_VOTES distinct pairs of consecutive items, or more, are equal in both; most votes first. ``i`` and ``j``: the equal pairs on each side.

    Every place of a pair votes, once for an offset. A pair with up to _CELLS combinations of places lists them; of one with more, all offsets
    are read off the correlation of its places, so a tone held for hours costs n log n and not n * n. Exact either way.
    """
    at_a, n_a, at_b, n_b = mine.first[i], mine.count[i], theirs.first[j], theirs.count[j]
    width, back = mine.n_items + theirs.n_items, theirs.n_items
    work = n_a * n_b

    if work.sum() <= _CELLS:
        found, votes = np.unique(_listed(mine.order, at_a, n_a, theirs.order, at_b, n_b)[1] + back, return_counts=True)
    else:
        total, size = np.zeros(width, np.int64), 1 << width.bit_length()
        for k in np.flatnonzero(work > _CELLS):
            x, y = np.zeros(size), np.zeros(size)
            x[mine.order[at_a[k] : at_a[k] + n_a[k]]] = 1
            y[theirs.order[at_b[k] : at_b[k] + n_b[k]]] = 1
            total += np.fft.irfft(np.fft.rfft(x) * np.conj(np.fft.rfft(y)), size)[np.arange(-back, mine.n_items)] > 0.5
        few = np.flatnonzero(work <= _CELLS)
        for part in np.split(few, np.flatnonzero(np.diff(np.cumsum(work[few]) // _CELLS)) + 1):
            total += np.bincount(_listed(mine.order, at_a[part], n_a[part], theirs.order, at_b[part], n_b[part])[1] + back, minlength=width)
        found, votes = np.arange(width), total
    found, votes = found[votes >= LEAST_VOTES] - back, votes[votes >= LEAST_VOTES]
    return found[np.lexsort((np.abs(found), -votes))].tolist()


class QueryIndex:
    """Distinct pairs of items of a block of queries in order, with all places of each in the block's items, which lie one query behind the other.

    ``at`` holds number of the pair * ``span`` + place and so rises: the places of pair k are between ``first[k]`` and ``first[k + 1]``, and those in some queries a run of them.
    """

    def __init__(self, queries: list[tuple[int, np.ndarray]]) -> None:
        self.ids, self.length = [q for q, _ in queries], np.array([len(x) for _, x in queries])
        self.base, self.longest, self.span = np.cumsum(self.length) - self.length, int(self.length.max()), int(self.length.sum()) + 1
        self.flat = np.concatenate([*[x for _, x in queries], np.zeros(self.longest, np.uint32)])  # so windows at its end are whole
        self.query = np.repeat(np.arange(len(queries), dtype=np.int32), self.length)
        place = np.flatnonzero(self.query[1:] == self.query[:-1])
        pair = _pairs(self.flat[: len(self.query)])[place]
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        fresh = np.flatnonzero(_fresh(pair))
        self.pair, self.first = pair[fresh], np.append(fresh, len(pair))
        self.at = place[order] + np.repeat(np.arange(len(fresh)) * self.span, np.diff(self.first))
        self._last, self._told = np.zeros(0, np.int32), {}

    def items_of(self, query: int) -> np.ndarray:
        return self.flat[self.base[query] : self.base[query] + self.length[query]]

    def _near(self, items: np.ndarray, query: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """False for offsets that can't have a passage: with fewer than LEAST_EQUAL distinct equal items; or with fewer than twice as many, which takes a run of
        WHOLE of the overlap, if neither the best run nor what lies beside it is so long. Where the best run is, it is kept in ``_told``. Overlaps of about one length are looked at together."""
        low = np.maximum(0, offset)
        size = np.minimum(len(items), self.length[query] + offset) - low
        theirs, near = self.base[query] + low - offset, np.zeros(len(query), bool)
        mine = np.concatenate([items, np.zeros(int(size.max(initial=0)), np.uint32)])
        order, done = np.argsort(size, kind="stable"), 0
        sizes = size[order]
        while done < len(order):
            next_ = sizes[done : done + _OVERLAPS // int(sizes[done])]
            some = order[done : done + max(1, int(np.searchsorted(next_ * np.arange(1, len(next_) + 1), _OVERLAPS, "right")))]
            done += len(some)
            wide = int(size[some[-1]])
            a, b = (np.lib.stride_tricks.as_strided(x, (len(x) - wide + 1, wide), 2 * x.strides)[at[some]] for x, at in ((mine, low), (self.flat, theirs)))
            cell = np.flatnonzero(a == b)
            row = cell // wide
            inside = cell - row * wide < size[some][row]
            inside &= (np.bincount(row[inside], minlength=len(some)) >= LEAST_EQUAL)[row]
            told = np.sort(row[inside] << 32 | a.ravel()[cell[inside]])
            distinct = np.bincount(told[_fresh(told)] >> 32, minlength=len(some))
            near[some[distinct >= 2 * LEAST_EQUAL]] = True
            few = np.flatnonzero((distinct >= LEAST_EQUAL) & (distinct < 2 * LEAST_EQUAL))
            if not len(few):
                continue
            a, b, n = a[few], b[few], size[some[few]]
            wrong = np.bitwise_count(a ^ b)
            gain = np.zeros((len(few), wide + 1), np.int32)
            np.cumsum(np.subtract(_ALLOWED, wrong, dtype=np.int16), axis=1, out=gain[:, 1:])
            edge, most = int((WHOLE * n).min()), int((n - WHOLE * n).max()) + 1
            gains = gain[:, edge:].max(axis=1) > gain[:, : most + 1].min(axis=1)  # else no run of WHOLE of the overlap does
            few, a, b, n, gain = few[gains], a[gains], b[gains], n[gains], gain[gains]
            gain[np.arange(wide + 1) > n[:, None]] = np.iinfo(np.int32).min // 2
            least = np.minimum.accumulate(gain, axis=1)
            end, each = (gain - least).argmax(axis=1), np.arange(len(few))
            start = (gain == least[each, end][:, None]).argmax(axis=1)
            run = end - start >= WHOLE * n
            for k in np.flatnonzero(~run & (np.maximum(start, n - end) >= WHOLE * n)).tolist():
                near[some[few[k]]] = gain[k, int(WHOLE * n[k]) : n[k] + 1].max() > gain[k, : int(n[k] - WHOLE * n[k]) + 1].min()
            for k in np.flatnonzero(run).tolist():  # the only passage that there may be
                x, y = int(start[k]), int(end[k])
                equal = len(set(a[k, x:y][a[k, x:y] == b[k, x:y]].tolist()))
                if equal >= LEAST_EQUAL:
                    j = int(some[few[k]])
                    near[j], at = True, int(low[j])
                    errors = round(float(_ALLOWED * (y - x) - (gain[k, y] - gain[k, x])) / (32 * (y - x)), 6)
                    self._told[int(query[j]), int(offset[j])] = [Passage(at + x, at + y, int(offset[j]), equal, errors)]
        return near

    def _voted(self, own: Places, mine: np.ndarray, pair: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, offset, votes) of offsets with enough votes. Pairs ``mine`` of a recording are ``pair`` here, with their places from ``low`` to ``high`` of ``at``.

        Each combination of places is one number, and most of these come once or twice by chance: each is written to where its number says, those that don't
        find themselves there have come again. Only what has come LEAST_VOTES times is told by pair and query."""
        by = np.argsort(low - high, kind="stable")
        mine, n = mine[by], own.count[mine[by]]
        each = np.repeat(np.arange(len(by)), n)  # of each place of a pair in the recording, its pair
        place = own.order[np.arange(len(each)) + np.repeat(own.first[mine] - (np.cumsum(n) - n), n)]
        low, high, shift = low[by][each], high[by][each], (pair[by] * self.span)[each] + place - own.n_items
        hits = high - low
        ends = np.cumsum(hits)
        number = np.empty(int(ends[-1]), np.int64)
        many = int(np.searchsorted(-hits, -_MANY, "right"))
        for x, y, z, end in zip(low[:many].tolist(), high[:many].tolist(), shift[:many].tolist(), ends[:many].tolist(), strict=True):
            np.subtract(self.at[x:y], z, out=number[end - y + x : end])
        rest = np.arange(int(ends[many - 1]) if many else 0, len(number))
        number[rest] = self.at[rest + np.repeat((low - ends + hits)[many:], hits[many:])] - np.repeat(shift[many:], hits[many:])
        if len(self._last) < self.span + own.n_items:
            self._last = np.zeros(self.span + own.n_items, np.int32)
        last, turn = self._last, np.arange(len(number), dtype=np.int32)
        last[number] = turn
        found = last[number]
        again = np.flatnonzero(found != turn)
        left = twice = number[again]
        for _ in range(LEAST_VOTES - 2):
            last[left] = turn[: len(left)]
            left = left[last[left] != turn[: len(left)]]
        last[left] = -1
        again = again[last[twice] < 0]
        marked = np.zeros(len(number), bool)
        marked[again] = marked[found[again]] = True  # those that found themselves are found by the others
        hit = np.flatnonzero(marked)
        of = np.searchsorted(ends, hit, "right")
        theirs = number[hit] - own.n_items + place[of]
        query = self.query[theirs]
        width = self.longest + own.n_items
        cell = query * width + place[of] - theirs + self.base[query] + self.longest
        order = np.argsort(cell, kind="stable")  # pairs stay together in a cell
        cell, of = cell[order], each[of[order]]
        cell = cell[_fresh(cell) | _fresh(of)]
        first = np.flatnonzero(_fresh(cell))
        votes = np.diff(first, append=len(cell))
        cells, votes = cell[first[votes >= LEAST_VOTES]], votes[votes >= LEAST_VOTES]
        return cells // width, cells % width - self.longest, votes

    def _candidates(self, own: Places, items: np.ndarray | None = None) -> Iterator[tuple[int, list[int]]]:
        """(query, offsets) for queries with an offset that has enough votes, in order. All queries vote at once; where their places have more than _CELLS
        combinations the queries are halved, down to one, which is asked by itself. With the recording's ``items``, offsets that ``_near`` rules out may be missing."""
        pair = np.searchsorted(self.pair, own.pair)
        mine = np.flatnonzero(self.pair[np.minimum(pair, len(self.pair) - 1)] == own.pair) if len(self.pair) else pair[:0]
        pair = pair[mine]
        parts = [(0, len(self.ids), mine, pair, self.first[pair], self.first[pair + 1])] if len(mine) else []
        while parts:
            start, end, mine, pair, low, high = parts.pop()
            if len(mine) < LEAST_VOTES:
                continue
            if (own.count[mine] * (high - low)).sum() <= _CELLS:
                query, offset, votes = self._voted(own, mine, pair, low, high)
                if items is not None and len(query):
                    near = self._near(items, query, offset)
                    query, offset, votes = query[near], offset[near], votes[near]
                best = np.lexsort((np.abs(offset), -votes, query))
                for run in np.split(best, np.flatnonzero(np.diff(query[best])) + 1):
                    if len(run):
                        yield int(query[run[0]]), offset[run].tolist()
            elif end - start == 1:
                theirs = places(self.items_of(start))
                if offsets := alike_offsets(own, theirs, mine, np.searchsorted(theirs.pair, own.pair[mine])):
                    yield start, offsets
            else:
                half = (start + end) // 2
                middle = np.searchsorted(self.at, pair * self.span + self.base[half])
                for x, y, a, b in ((half, end, middle, high), (start, half, low, middle)):  # the first half is taken first
                    some = b > a
                    parts.append((x, y, mine[some], pair[some], a[some], b[some]))

    def align(self, items: np.ndarray) -> list[dict]:
        """The passages that a recording shares with each query, at every offset, but for those of which passages at offsets with more votes
        cover half in the recording and half in the query. A passage that comes again on either side is found at each of its places."""
        out = []
        self._told.clear()
        for q, offsets in self._candidates(places(items), items):
            theirs, kept = self.items_of(q), []
            mine_told, theirs_told = np.zeros(len(items), bool), np.zeros(len(theirs), bool)
            for offset in offsets:
                low, high = max(0, offset), min(len(items), len(theirs) + offset)
                if mine_told[low:high].all() and theirs_told[low - offset : high - offset].all():
                    continue
                for p in self._told.get((q, offset)) or passages(items, theirs, offset):
                    here, there = mine_told[p.low : p.high], theirs_told[p.low - offset : p.high - offset]
                    if 2 * min(here.sum(), there.sum()) < p.high - p.low:
                        kept.append(p)
                        here[:] = there[:] = True
            out += [{"query_id": self.ids[q], "offset": p.offset, "start": p.low, "equal": p.equal, "overlap": p.high - p.low, "errors": p.errors} for p in sorted(kept)]
        return out


_MATCH = "query_id bigint, offset bigint, start bigint, equal bigint, overlap bigint, errors double"
_ROWS = pa.schema([("audio_key", pa.int64()), *[(c, pa.int64()) for c in ("query_id", "offset", "start", "equal", "overlap")], ("errors", pa.float64())])


def _blocks(queries: DataFrame) -> Iterator[QueryIndex]:
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for r in queries.orderBy("recording").toLocalIterator():
        items = np.frombuffer(r["items"], np.uint32)
        if held and size + len(items) > QUERY_ITEMS:
            yield QueryIndex(held)
            held, size = [], 0
        held.append((r["recording"], items))
        size += len(items)
    if held:
        yield QueryIndex(held)


def align(docs: DataFrame, audio: Column, query: Column, id_col: str = "doc_id", form: Form = MUSIC) -> DataFrame:
    """One row per row of ``docs``: doc_id, recording (smallest id with equal audio), n_items, matches.

    Queries are the recordings with a row for which ``query`` (over the id) holds; ``matches`` lists the passages that a recording
    shares with them: query_id (its recording), offset in frames (place in the recording less that in the query), start (place in the recording), equal
    (distinct equal items), overlap in items, errors (share of wrong bits). A passage inside two long recordings counts, and one that comes
    again on either side is reported at each place, unless passages with more votes tell of both of its sides (see ``QueryIndex.align``). A
    recording with fewer than LEAST_EQUAL distinct items is too short to tell and only shares its ``recording`` with equal audio. Null and empty audio, and audio shorter than ``form.least``, has no items and no
    matches; equal audio shares its ``recording``. Rows without an id are matched but never queries. Columns of other names are not looked at.
    """

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in fingerprints([x.as_buffer() for x in batch.column("audio")], form)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("audio_key"), pa.array(found, pa.binary())], ["doc_id", "audio_key", "items"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), audio.alias("audio")).withColumn("audio_key", F.xxhash64("audio"))
    prints = staged(given.mapInArrow(printed, "doc_id long, audio_key long, items binary"))
    classes = cut(prints.groupBy("audio_key").agg(F.min("doc_id").alias("recording"), F.max(F.coalesce(query, F.lit(False))).alias("asked")))
    mine = prints.filter("octet_length(items) > 0").join(classes, "audio_key")
    once = staged(mine.filter("doc_id <=> recording").dropDuplicates(["audio_key"]).select("audio_key", "recording", "asked", "items"))
    spark, paths = docs.sparkSession, []
    total = (once.agg(F.sum(F.octet_length("items"))).first()[0] or 0) // 4
    parts = max(spark.sparkContext.defaultParallelism, -(-total // _EACH))
    for index in _blocks(once.filter("asked and recording is not null").select("recording", "items")):
        shared = spark.sparkContext.broadcast(index)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: list[dict] = []
                for key, items in zip(batch.column("audio_key").to_pylist(), batch.column("items"), strict=True):
                    rows += [{"audio_key": key} | r for r in shared.value.align(np.frombuffer(items.as_py(), np.uint32))]
                    if len(rows) >= _TOLD:
                        yield pa.RecordBatch.from_pylist(rows, _ROWS)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ROWS)

        paths.append(stage(once.select("audio_key", "items").repartition(parts, "audio_key").mapInArrow(work, "audio_key bigint, " + _MATCH)))
        shared.destroy()
    slim = prints.select("doc_id", "audio_key", (F.octet_length("items") / 4).cast("long").alias("n_items")).join(classes.select("audio_key", "recording"), "audio_key")
    none = F.array().cast(f"array<struct<{_MATCH}>>")
    if not paths:
        return slim.select("doc_id", "recording", "n_items", none.alias("matches"))
    rows = spark.read.schema("audio_key bigint, " + _MATCH).parquet(*paths)
    matched = rows.groupBy("audio_key").agg(F.sort_array(F.collect_list(F.struct("query_id", "offset", "start", "equal", "overlap", "errors"))).alias("matches"))
    return slim.join(matched, "audio_key", "left").select("doc_id", "recording", "n_items", F.coalesce("matches", none).alias("matches"))
