"""Alignment of passages: inside long recordings, of clips, of repeats; the vote search against all offsets."""

import numpy as np
from pyspark.sql import functions as F

from loomgraph.llm import chroma

r = np.random.default_rng(11)
HOP = chroma.SHORT.hop


def noise(items, form=chroma.SHORT):
    """Audio of so many items whose parts are all different."""
    n = form.least + (items - 1) * form.hop
    return r.integers(0, 256, n).astype(np.uint8).tobytes()


def brute(mine, theirs, form=chroma.SHORT):
    """The places of each passage at any offset."""
    a, b = chroma.fingerprint(mine, form), chroma.fingerprint(theirs, form)
    return [set(range(p.low, p.high)) for offset in range(1 - len(b), len(a)) for p in chroma.passages(a, b, offset)]


def found(matches, query):
    return {i for m in matches if m["query_id"] == query for i in range(m["start"], m["start"] + m["overlap"])}


def test_passages_of_all_kinds_equal_brute_force(spark):
    jingle, clip = noise(40), noise(20)
    jingle, clip = jingle[: len(jingle) // HOP * HOP], clip[: len(clip) // HOP * HOP]
    pad = lambda k: noise(k)[: HOP * k]
    audio = {
        100: pad(200) + jingle + pad(300),  # a query that shares only the jingle
        200: clip,  # a query that lies whole in another recording
        1: pad(500) + jingle + pad(100),
        2: pad(70) + clip + pad(90),
        3: jingle + pad(64) + jingle + pad(40) + jingle,  # three times
        4: pad(60) + noise(50),
        5: pad(90) + jingle[: HOP * 30] + pad(50) + jingle,
        6: noise(1)[: chroma.SHORT.least - 1],  # no item
        7: b"",
    }
    given = spark.createDataFrame([(i, bytearray(a)) for i, a in audio.items()] + [(8, None), (9, bytearray(audio[4])), (None, bytearray(audio[1]))], "doc_id long, audio binary")
    out = {x["doc_id"]: x for x in chroma.align(given, F.col("audio"), F.col("doc_id") % 100 == 0, form=chroma.SHORT).collect()}
    assert len(out) == 12 and out[9]["recording"] == 4 and not any(out[i]["n_items"] for i in (6, 7, 8))
    for i, a in audio.items():
        for q in (100, 200):
            have = found(out[i]["matches"], q)  # a passage a step aside is left out for the better one that covers half of it
            assert all(2 * len(p & have) >= len(p) for p in brute(a, audio[q])), (i, q)
    assert [m["query_id"] for m in out[1]["matches"]] == [100] and out[1]["matches"][0]["offset"] == 300
    assert [m["query_id"] for m in out[2]["matches"]] == [200] and out[2]["matches"][0]["offset"] == 70
    step = len(jingle) // HOP
    assert [m["offset"] + 200 for m in out[3]["matches"]] == [0, step + 64, 2 * step + 104]
    assert not out[4]["matches"] and [x["matches"] for k, x in out.items() if k is None] == [out[1]["matches"]]
    assert [(m["query_id"], m["errors"], m["overlap"]) for m in out[200]["matches"]] == [(200, 0.0, out[200]["n_items"])]


def test_places_beyond_a_million_frames():
    part = np.arange(1, 50, dtype=np.uint32)
    far = np.concatenate([np.zeros(3_000_000, np.uint32), part])
    index = chroma.QueryIndex([(5, part), (6, far[: 10] + np.uint32(7))])
    assert [(m["query_id"], m["offset"], m["errors"]) for m in index.align(far) if m["overlap"] > 40] == [(5, 3_000_000, 0.0)]


def test_music_form_aligns_a_section():
    t = np.arange(30 * chroma.MUSIC.rate)
    notes = 220 * 2 ** (np.repeat(r.integers(0, 24, 120), len(t) // 120 + 1)[: len(t)] / 12)
    wave = 128 + 70 * np.sin(2 * np.pi * np.cumsum(notes) / chroma.MUSIC.rate)
    audio = [x.clip(0, 255).astype(np.uint8).tobytes() for x in (wave, wave[chroma.MUSIC.hop * 60 :] + r.normal(0, 4, len(wave) - chroma.MUSIC.hop * 60))]
    whole, part = (chroma.fingerprint(a) for a in audio)
    (match,) = chroma.QueryIndex([(1, whole)]).align(part)
    assert match["offset"] == -60 and match["overlap"] > 0.9 * len(part) and match["errors"] < 0.15


def items_of(*parts):
    return np.concatenate(parts).astype(np.uint32)


def test_passages_that_come_again_on_either_side_are_all_found():
    one, two, gap, rest = (r.integers(0, 2**32, k) for k in (30, 40, 25, 50))
    told = lambda q, x: sorted((m["start"], m["offset"], m["overlap"]) for m in chroma.QueryIndex([(1, q)]).align(x))
    assert told(items_of(one, two), items_of(one, one, gap, two)) == [(0, 0, 30), (30, 30, 30), (85, 55, 40)]
    assert told(items_of(one, gap, one, two), items_of(one)) == [(0, -55, 30), (0, 0, 30)]
    assert told(items_of(one, two), items_of(two, gap, one, rest, one, two, one)) == [(0, -30, 40), (65, 65, 30), (145, 145, 70), (215, 215, 30)]
    assert told(items_of(one, gap), items_of(rest, one, rest, one)) == [(50, 50, 30), (130, 130, 30)]


def offsets(a, b):
    a, b = chroma.places(a), chroma.places(b)
    _, i, j = np.intersect1d(a.pair, b.pair, assume_unique=True, return_indices=True)
    return chroma.alike_offsets(a, b, i, j)


def test_queries_asked_at_once_and_one_by_one_agree(monkeypatch):
    queries = [(k, np.concatenate([np.tile(r.integers(0, 9, 11), 5), r.integers(0, 9, 60)]).astype(np.uint32)) for k in range(8)]
    index = chroma.QueryIndex(queries)
    for _, x in queries:
        x = np.concatenate([x[20:], queries[3][1][:40], x[:30]])
        both = list(index._candidates(chroma.places(x)))
        monkeypatch.setattr(chroma, "_CELLS", 50)
        assert both and list(index._candidates(chroma.places(x))) == both
        monkeypatch.undo()


def test_votes_equal_a_count_of_all_offsets():
    for size, kinds in ((60, 3), (80, 12), (50, 2000)):
        a, b = (np.concatenate([np.tile(r.integers(0, kinds, 7), 4), r.integers(0, kinds, size)]).astype(np.uint32) for _ in range(2))
        votes = {}
        for i in range(len(a) - 1):
            for j in range(len(b) - 1):
                if a[i] == b[j] and a[i + 1] == b[j + 1]:
                    votes.setdefault(i - j, set()).add((a[i], a[i + 1]))
        want = sorted((-len(v), abs(o), o) for o, v in votes.items() if len(v) >= chroma.LEAST_VOTES)
        for cells in (1 << 20, 7):  # listed, and correlated
            was, chroma._CELLS = chroma._CELLS, cells
            got = offsets(a, b)
            chroma._CELLS = was
            assert sorted((-len(votes[o]), abs(o), o) for o in got) == want and [-len(votes[o]) for o in got] == [v for v, _, _ in want]


def test_a_tone_and_a_loop_held_long_are_cheap():
    tone, loop = np.full(200_000, 9, np.uint32), np.tile(np.arange(1, 9, dtype=np.uint32), 5_000)
    assert offsets(tone, tone) == []
    (match,) = chroma.QueryIndex([(1, loop)]).align(loop)
    assert (match["offset"], match["overlap"], match["errors"]) == (0, len(loop), 0.0)
    assert offsets(tone[:1], loop) == [] and offsets(tone[:0], loop) == []


def test_short_recordings_are_worked_on_together(monkeypatch):
    sizes = [*r.integers(0, 3000, 200), chroma.SHORT.least - 1, chroma.SHORT.least, 200_000]
    audio = [None, b"", *(r.integers(0, 256, n).astype(np.uint8).tobytes() for n in sizes), bytes([chroma.SILENCE]) * 1000]
    alone = [chroma.fingerprint(x, chroma.SHORT) for x in audio]
    calls, plain = [], chroma.chroma
    monkeypatch.setattr(chroma, "chroma", lambda waves, form: calls.append(len(waves)) or plain(waves, form))
    assert all(np.array_equal(x, y) for x, y in zip(chroma.fingerprints(audio, chroma.SHORT), alone, strict=True))
    assert len(calls) < 20 and sum(calls) == sum(len(x) > 0 for x in alone)


def test_offsets_with_few_equal_items_are_not_tried(monkeypatch):
    shared, jingle = r.integers(0, 2**32, (2, 12))
    rest = r.integers(0, 2**32, (40, 30))
    index = chroma.QueryIndex([(k, items_of(x, shared[:4], x[:9], jingle if k == 7 else x[:5])) for k, x in enumerate(rest)])
    x = items_of(r.integers(0, 2**32, 20), shared[:5], r.integers(0, 2**32, 20), jingle)
    monkeypatch.setattr(index, "_near", lambda items, query, offset: np.ones(len(query), bool))
    want = index.align(x)
    monkeypatch.undo()
    tried, plain = [], chroma.passages
    monkeypatch.setattr(chroma, "passages", lambda *a: tried.append(a) or plain(*a))
    assert index.align(x) == want and [m["query_id"] for m in want] == [7] and len(tried) == 1


def test_of_many_queries_only_those_with_too_many_places_are_asked_alone(monkeypatch):
    common, loop = r.integers(0, 2**32, 30), np.tile([5, 6], 40)
    queries = [(k, items_of(r.integers(0, 2**32, 20), common, loop if k == 33 else [])) for k in range(64)]
    index, x = chroma.QueryIndex(queries), items_of(common, r.integers(0, 2**32, 20), loop)
    want = index.align(x)
    alone, plain = [], chroma.alike_offsets
    monkeypatch.setattr(chroma, "alike_offsets", lambda *a: alone.append(a) or plain(*a))
    monkeypatch.setattr(chroma, "_CELLS", 500)  # all queries together have more combinations
    assert index.align(x) == want and {m["query_id"] for m in want} == set(range(64)) and len(alone) == 1


def test_scattered_equal_items_are_not_tried(monkeypatch):
    far, bits = r.integers(0, 2**32, 400), np.uint32(0xFFFF)
    places = np.array([10, 11, 12, 13, 120, 210, 211, 300])  # eight equal items, half of all other bits wrong
    other = items_of(far) ^ bits
    other[places] = far[places]
    short = items_of(far[:9], far[9:11] ^ 1, far[11:20])
    index = chroma.QueryIndex([(1, other), (2, short), (3, items_of(far[200:209], far[209:211] ^ 7))])
    x = items_of(far)
    monkeypatch.setattr(index, "_near", lambda items, query, offset: np.ones(len(query), bool))
    want, whole, some = index.align(x), index.align(short), index.align(items_of(far[203:211]))
    monkeypatch.undo()
    tried, plain = [], chroma.passages
    monkeypatch.setattr(chroma, "passages", lambda *a: tried.append(a) or plain(*a))
    assert index.align(x) == want and {m["query_id"] for m in want} == {2, 3} and len(tried) == 1  # 18 equal items; the runs of nine are known
    assert index.align(short) == whole and index.align(items_of(far[203:211])) == some and some


def test_recordings_are_dealt_to_tasks_by_their_items(spark, monkeypatch):
    given = spark.createDataFrame([(k, bytearray(noise(30))) for k in range(60)], "doc_id long, audio binary").coalesce(1)
    tasks, plain = [], chroma.stage
    monkeypatch.setattr(chroma, "stage", lambda df: tasks.append(df.rdd.getNumPartitions()) or plain(df))
    monkeypatch.setattr(chroma, "_EACH", 100)
    chroma.align(given, F.col("audio"), F.col("doc_id") % 10 == 0, form=chroma.SHORT)
    assert tasks == [18]
