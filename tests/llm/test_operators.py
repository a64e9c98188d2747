"""The ten operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chroma, decontam, lines, minimax, mixing, oddsketch, quality, substrings, toxicity, warc
from loomgraph.plans.shared import shared_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(5)


def prose(n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def _corpus():
    base, shared = prose(120), prose(50)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), prose(80) + " " + shared, shared + " " + prose(70), prose(3000), "one", "one two", "", None, " \n\t ", "De " * 90, "a\nb\nc\nd\ne", "x\na\nb\nc\nd\ny", "A B C", base.upper()]
    rows = [(i, t, "en", ["s1", "s2", None][i % 3], len(t or ""), "clash", 1) for i, t in enumerate(texts)]
    return rows + [rows[0], (None, "no id", None, None, None, None, None)]


CORPUS = _corpus()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, SCHEMA).repartition(3).cache()


def test_minimax_shards_are_the_smallest_that_fit(spark, docs):
    out = minimax.minimax_shards(docs, shards=4).collect()
    assert len(out) == len(CORPUS) and all(r["law"] == "bytes" and r["grown_shard"] is None for r in out)
    for shard in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in out)))
    sizes = [r["s"] for r in docs.groupBy(F.xxhash64("text").alias("k")).agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("s")).orderBy("k").collect()]
    alone = []  # groups beyond a fair share fill a shard each, whichever way the others lie
    while len(alone) < 3 and max(sizes) > sum(sizes) / (4 - len(alone)):
        alone.append(max(sizes))
        sizes.remove(alone[-1])

    def fits(capacity):
        shards, room = 1, capacity
        for s in sizes:
            if s > capacity:
                return False
            shards, room = (shards, room - s) if s <= room else (shards + 1, capacity - s)
        return shards <= 4 - len(alone)

    least = max([*alone, next(c for c in range(1, sum(sizes) + 1) if fits(c))])
    made = Counter({k: sum(r["size"] for r in out if r["shard"] == k) for k in range(4)})
    assert max(made.values()) <= least == out[0]["capacity"] and min(made.values()) > 0
    assert minimax.minimax_shards(docs.limit(0)).count() == 0


def test_shards_are_even_beside_a_text_that_a_third_of_all_rows_share(spark):
    rows = [(i, "hot text " * 30 if i % 3 == 0 else f"{i} " * (5 + i % 80)) for i in range(2000)]
    out = minimax.minimax_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    made = Counter()
    for r in out:
        made[r["shard"]] += r["size"]
    hot = {r["shard"] for r in out if r["doc_id"] % 3 == 0}
    rest = [made[k] for k in range(16) if k not in hot]
    assert len(hot) == 1 and len(rest) == 15 and max(rest) <= 1.02 * min(rest)
    few = minimax.minimax_shards(spark.createDataFrame([(i, "ab" * (i % 20)) for i in range(100)], "doc_id long, text string")).collect()
    assert {r["shard"] for r in few} == set(range(16)) and len({(r["text_crc32"], r["shard"]) for r in few}) == 20


def test_even_cuts_against_every_partition():
    for _ in range(300):
        sizes = [rng.choice([1, 2, 3, 9, 20]) for _ in range(rng.randint(1, 9))]
        shards = rng.randint(1, 5)
        ends = np.cumsum(sizes)
        best = minimax._smallest(ends, max(sizes), shards)
        cuts = [0, *minimax.even_cuts(ends, best, shards), len(sizes)]
        parts = [sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])]
        assert cuts == sorted(cuts) and max(parts) <= best and sum(parts) == sum(sizes)
        assert len(sizes) < shards or min(parts) > 0


def test_mixing_meets_its_targets_and_repeats_itself(spark, docs):
    out = mixing.mixed_counts(docs, block=16).collect()
    assert sorted(map(str, out)) == sorted(map(str, mixing.mixed_counts(docs, block=16).collect()))
    sizes = {s: sum(len(WORD.findall(t or "")) for _, t, _, src, *_ in CORPUS if src == s) for s in ("s1", "s2", None)}
    assert {r["source_size"] for r in out} == set(sizes.values()) and all(r["taken"] <= 3 * r["size"] for r in out)
    for size in sizes.values():
        own = [r for r in out if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    assert mixing.targets([10, 0, 1000]) == [30, 0, 980] and mixing.targets([]) == []
    made = mixing.mixed_documents(docs, block=16)
    assert made.columns == docs.columns and sum(len(WORD.findall(r["text"])) for r in made.collect()) == sum(r["taken"] for r in out)
    n = np.array([1, 2, 7, 100])
    for m in n:
        assert sorted(mixing.permuted(np.arange(m), np.full(m, m), np.full(m, 9, np.uint64))) == list(range(m))
    assert mixing.mixed_counts(docs.limit(0)).count() == 0


def test_substrings_are_those_that_repeat(spark, docs):
    window, texts = 35, [(i, WORD.findall(t or "")) for i, t, *_ in CORPUS]
    count = Counter(tuple(w[k : k + window]) for _, w in texts for k in range(len(w) - window + 1))
    want = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        want.append((str(i), len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    out = substrings.repeated_substrings(docs)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()) == sorted(want)
    assert substrings.repeated_substrings(docs.limit(0)).count() == 0


def test_near_duplicates_are_the_components_of_all_links(spark, docs):
    sets = {}
    for i, t, *_ in CORPUS:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets if i is not None}
    for _ in sets:
        for a in label:
            for b in label:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    out = oddsketch.near_duplicates(docs, 3, 85, 100).collect()
    assert len(out) == len(CORPUS)
    for r in out:
        assert r["n_shingles"] == len(sets[r["doc_id"]]) and (r["doc_id"] is None or (r["component_id"], r["kept"]) == (label[r["doc_id"]], label[r["doc_id"]] == r["doc_id"]))
    kept = oddsketch.deduplicated(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {None} | set(label) - {1, 2, 15}
    assert oddsketch.near_duplicates(docs.limit(0)).count() == 0


def test_giant_groups_meet_by_blocks_as_in_one(spark, monkeypatch):
    base = prose(60).split()
    texts = [" ".join(w + ("x" * (rng.random() < 0.02)) for w in base) for _ in range(150)]
    far = base[:40] + prose(20).split()
    texts += [" ".join(far), " ".join(far[:-1]), " ".join(base[:48] + prose(6).split()), *(prose(30) for _ in range(20)), texts[3], texts[3]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = sorted(oddsketch.near_duplicates(docs, 3, 85, 100).collect())
    monkeypatch.setattr(oddsketch, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(oddsketch, "SET_BLOCK", 8)
    assert sorted(oddsketch.near_duplicates(docs, 3, 85, 100).collect()) == want
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in map(str.split, texts)]
    label = list(range(len(sets)))
    for _ in range(4):
        for i in range(len(sets)):
            for j in range(i):
                if label[i] != label[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    old, new = max(label[i], label[j]), min(label[i], label[j])
                    label = [new if x == old else x for x in label]
    assert [r["component_id"] for r in want] == label


def test_odd_sketches_estimate_high_similarities():
    one = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 2000, dtype=np.uint64))
    for share in (0.95, 0.8):
        k = int(len(one) * share)
        other = np.concatenate([one[:k], one[k:] + np.uint64(1)])
        true = k / (2 * len(one) - k)
        a, b = oddsketch.odd_sketches(oddsketch.minhashes([one, np.unique(other)]))
        bits = int(np.bitwise_count(a ^ b).sum())
        assert abs(float(oddsketch.similarity(np.array(bits))) - true) < 0.16 and bits <= oddsketch.most_differing(true)


def test_line_runs(spark, docs):
    out = {r["doc_id"]: r for r in lines.repeated_runs(docs, least=3).collect()}
    assert (out[13]["n_lines"], out[13]["n_removed"], out[13]["kept_text"]) == (6, 4, "x\ny") and out[12]["n_removed"] == 0
    assert out[9]["kept_text"] is None and out[8]["n_lines"] == 1 and lines.repeated_runs(docs.limit(0)).count() == 0
    texts = ["\n".join(rng.choice("pqr") for _ in range(rng.randint(1, 12))) for _ in range(12)]
    small = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, want = set(), {}
    for i, t in enumerate(texts):
        ls = t.split("\n")
        gone = set()
        for k in range(len(ls) - 2):
            run = tuple(ls[k : k + 3])
            gone |= set(range(k, k + 3)) if run in seen else set()
            seen.add(run)
        want[i] = "\n".join(x for k, x in enumerate(ls) if k not in gone)
    assert {r["doc_id"]: r["kept_text"] for r in lines.repeated_runs(small, least=3).collect()} == want


def test_warc_round_trip_and_salvage(spark):
    pages = spark.createDataFrame([(3, "http://a/\r\nX: y", "same"), (1, None, "same"), (2, "u", None), (5, "u", ""), (4, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (4, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n")], "page_id long, url string, html string")
    path = f"{shared_folder(spark)}/warc-test-{rng.random()}"
    warc.write_archives(pages, path)
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_archives(spark, path).collect()}
    digest = lambda x: warc._sha1(x.encode())
    odd = "WARC/1.1\r\nWARC-Type: response\r\n\r\n"
    assert got == {(1, "response", None, 4, digest("same")), (3, "revisit", 1, 4, digest("same")), (2, "response", None, 0, digest("")), (5, "revisit", 2, 0, digest("")), (4, "response", None, len(odd), digest(odd))}
    records = [warc.record(i, "u", f"page {i}".encode(), digest(f"page {i}"), i, "2024-01-01T00:00:00Z") for i in range(4)]
    packed = [warc.member(r) for r in records]
    broken = packed[0] + packed[1][:-20] + packed[2] + b"junk" + packed[3]
    found = list(warc.salvage(broken))
    assert [r["page_id"] for _, _, r in found if isinstance(r, dict)] == [0, 2, 3]
    gaps = [(a, b) for a, b, r in found if isinstance(r, str)]
    assert gaps == [(len(packed[0]), len(packed[0]) + len(packed[1]) - 20), (len(broken) - len(packed[3]) - 4, len(broken) - len(packed[3]))]
    bad = records[1].replace(b"page 1", b"page X")
    plain = list(warc.salvage(records[0] + bad + records[2]))
    assert [r["page_id"] if isinstance(r, dict) else r for _, _, r in plain] == [0, "block digest", 2]
    assert list(warc.salvage(b"")) == []


def test_decontamination_finds_all_within_the_budget(spark, docs):
    item = CORPUS[0][1].split()[20:60]
    edited = item[:5] + item[6:20] + ["new", "words"] + item[20:]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "zz yy xx ww")], "item_id long, text string")
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(90, "q " * 9 + " ".join(edited).upper() + "!"), (91, " ".join(item[:20]))], "doc_id long, text string"))
    out = {r["doc_id"]: r for r in decontam.contamination(more, bench, 0.2).collect()}
    assert {i for i, r in out.items() if r["contaminated"]} == {0, 1, 2, 15, 90}
    assert out[90]["hits"][0]["distance"] == 3
    for _ in range(200):
        p, t = [rng.choice("ab") for _ in range(rng.randint(1, 8))], [rng.choice("abc") for _ in range(rng.randint(0, 15))]
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert decontam.nearest_end(p, t)[0] == min(row)
    assert decontam.without_leaks(docs, bench).count() == len(CORPUS) - 5 and decontam.contamination(docs.limit(0), bench).count() == 0


def labelled(spark):
    rows, labels = [], []
    for i in range(240):
        bad, rude = i % 4 == 0, i % 5 == 0
        words = prose(60).split()
        if rude:
            words[7] = words[31] = rng.choice(["grobian", "grobians", "lout"])
        rows.append((i, " ".join(w + ("&&&" if bad and k % 2 else "") for k, w in enumerate(words)), "x"))
        labels.append((i, int(not bad), int(rude)))
    rows += [(500, None, "x"), (501, "", "x"), (None, "text", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (0, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def test_quality_and_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    good = {r["doc_id"]: r for r in quality.quality(docs, labels).collect()}
    rude = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(good) == len(rude) == 243 and all(0 <= r["score"] <= 1 for r in [*good.values(), *rude.values()])
    assert all(good[i]["predicted"] == (i % 4 != 0) for i in range(240) if good[i]["held_out"])
    assert all(rude[i]["predicted"] == (i % 5 == 0) for i in range(240) if rude[i]["held_out"])
    assert all(r["evidence"] for i, r in rude.items() if r["predicted"]) and rude[500]["predicted"] == 0
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 243 - 48
    assert quality.quality(docs.limit(0), labels).count() == 0 and toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).count() == 243


def test_nearest_examples_are_exact():
    r = np.random.default_rng(2)
    n, width = 300, 40
    rows, terms = np.repeat(np.arange(n), 12), r.integers(0, width, 12 * n)
    first, term, count = toxicity.bag(rows, terms, n)
    weight = r.random(width) + 0.1
    index = toxicity.BlockMaxIndex.build(np.arange(width, dtype=np.uint64), weight, first, term, count, r.integers(0, 2, n), np.arange(n), np.ones(n), 0.1)
    dense = np.zeros((n, width))
    np.add.at(dense, (rows, terms), 1)
    dense = np.where(dense > 0, 1 + np.log(np.maximum(dense, 1)), 0) * weight
    dense /= np.linalg.norm(dense, axis=1)[:, None]
    for _ in range(60):
        t = np.sort(r.choice(width, r.integers(1, 9), replace=False))
        q = r.random(len(t))
        place, cosine = index.nearest(t, q, 10)
        want = dense[:, t] @ q
        assert np.allclose(cosine, np.sort(want[want > 0])[::-1][:10], atol=1e-6) and np.allclose(want[index.ids[place]], cosine, atol=1e-6)


def test_long_lists_are_not_read_posting_by_posting(monkeypatch):
    r = np.random.default_rng(5)
    n, width, common = 700, 400, 40
    rows = np.concatenate([np.repeat(np.arange(n), 30), np.repeat(np.arange(n), 6), [0, 1]])
    terms = np.concatenate([r.integers(0, common, 30 * n), r.integers(common, width, 6 * n), [width, width]])
    first, term, count = toxicity.bag(rows, terms, n)
    twin = slice(first[600], first[601])  # the last examples are copies of one: ties
    first = np.concatenate([first, first[-1] + (first[601] - first[600]) * np.arange(1, 41)])
    term, count = (np.concatenate([x, np.tile(x[twin], 40)]) for x in (term, count))
    n += 40
    weight = np.where(np.arange(width + 1) < common, 0.2, 1.0) * (r.random(width + 1) + 0.5)
    index = toxicity.BlockMaxIndex.build(np.arange(width + 1, dtype=np.uint64), weight, first, term, count, r.integers(0, 2, n), np.arange(n), np.ones(n), 0.1)
    dense = np.zeros((n, width + 1))
    dense[np.repeat(np.arange(n), np.diff(first)), term] = (1 + np.log(count)) * weight[term]
    dense = (dense / np.linalg.norm(dense, axis=1)[:, None])[index.ids]
    queries = [np.sort(r.choice(width, 60, replace=False)) for _ in range(300)] + [np.zeros(0, np.int64), np.array([width]), term[twin]]
    values = [r.random(len(q)) for q in queries]
    index.nearest(queries[0], values[0], 10)
    read, ranges = [], toxicity._ranges
    monkeypatch.setattr(toxicity, "_ranges", lambda *x: (read.append(len(out := ranges(*x))), out)[1])
    found = [index.nearest(q, v, 25) for q, v in zip(queries, values, strict=True)]
    assert sum(read) < sum(np.bincount(term, minlength=width + 1)[q].sum() for q in queries) / 4
    together = list(index.nearest_each(np.cumsum([0, *map(len, queries)]), np.concatenate(queries), np.concatenate(values), 25))
    for q, v, one, (place, cosine) in zip(queries, values, found, together, strict=True):
        want = dense[:, q] @ v
        best = np.sort(want[want > 0])[::-1][:25]
        assert one[0].tolist() == place.tolist() and np.allclose(cosine, best, atol=1e-6) and np.allclose(want[place], cosine, atol=1e-6)
    assert len(together[-3][0]) == 0 and len(together[-2][0]) == 2
    assert (np.diff(together[-1][0]) > 0).all() and len(set(together[-1][1].tolist())) == 1  # equal cosines, by place


def test_words_are_looked_up_by_their_first_bits():
    r = np.random.default_rng(3)
    for size in (0, 1, 1000):
        known = np.unique(np.r_[r.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2), np.arange(size // 10, dtype=np.uint64), [np.uint64(2**64 - 1)] * (size > 1)].astype(np.uint64))
        row, hashes = r.integers(0, 9, 5000), np.concatenate([r.choice(known, 3000) if size else np.zeros(3000, np.uint64), r.integers(0, 1 << 63, 2000, dtype=np.uint64)])
        first, term, count = toxicity.Vocabulary(known).bag(row, hashes, 10)
        want, within = {}, set(known.tolist())
        for i, h in zip(row.tolist(), hashes.tolist(), strict=True):
            if h in within:
                want[i, h] = want.get((i, h), 0) + 1
        own = np.repeat(np.arange(10), np.diff(first))
        assert dict(zip(zip(own.tolist(), known[term].tolist(), strict=True), count.tolist(), strict=True)) == want


def test_terms_and_whole_texts():
    long = " ".join(["mild"] * 300_000) + " Überzähliges"  # beyond a piece
    (low, high, row, term), *more = toxicity.counted(pa.array([None, "", "One's 2 ones", long]))
    assert low == 0 and sorted(np.bincount(row, minlength=high)[:3]) == [0, 0, 3]  # one, s, ones
    last = [x for x in toxicity.counted(pa.array([long, "überzähliges ÜBERZ"]))]
    hashes = [set(t[r == i].tolist()) for a, b, r, t in last for i in range(b - a)]
    assert len(hashes[0]) == 3 and len(hashes[0] & hashes[1]) == 2  # mild; the long word and its beginning, "überz", which as a word is another term


def test_toxicity_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "you lout", 1), (1, "you lout", 1), (7, "fine day", 2), (4, None, 3), (None, "lout", 4), (6, "other words here", 5)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (7, 0, 0), (None, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out)
    scores = {r["doc_id"]: r for r in out}
    assert not scores[6]["evidence"] and scores[4]["score"] == scores[6]["score"] and min(scores[None]["score"], scores[1]["score"]) > scores[7]["score"]
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.quality(docs, labels).collect() if r["doc_id"] == 1} and quality.quality(docs, labels).count() == 6


def test_chroma_aligns_shifted_recordings(spark):
    r = np.random.default_rng(3)
    t = np.arange(12_000)
    notes = np.repeat(r.integers(220, 900, 24), 500)
    wave = (128 + 60 * np.sin(2 * np.pi * notes * t / chroma.SHORT.rate) + 10 * r.standard_normal(len(t))).clip(0, 255).astype(np.uint8)
    noisy = (wave[chroma.SHORT.hop * 40 :].astype(int) + r.integers(-3, 4, len(wave) - chroma.SHORT.hop * 40)).clip(0, 255).astype(np.uint8)
    other = (128 + 60 * np.sin(2 * np.pi * np.repeat(r.integers(220, 900, 24), 500) * t / chroma.SHORT.rate)).clip(0, 255).astype(np.uint8)
    rows = [(100, wave.tobytes()), (7, noisy.tobytes()), (8, other.tobytes()), (9, b""), (10, None), (200, wave.tobytes()), (None, b"x")]
    audio = spark.createDataFrame([(i, bytearray(a) if a is not None else None, "clash") for i, a in rows], "doc_id long, audio binary, recording string")
    out = {r["doc_id"]: r for r in chroma.align(audio, F.col("audio"), F.col("doc_id") % 100 == 0, form=chroma.SHORT).collect()}
    assert len(out) == 7 and out[200]["recording"] == 100 and [m["query_id"] for m in out[200]["matches"]] == [100]
    assert [(m["query_id"], m["offset"]) for m in out[7]["matches"]] == [(100, -40)] and out[7]["matches"][0]["errors"] < 0.2
    assert not out[8]["matches"] and out[9]["n_items"] == 0 and out[10]["n_items"] == 0 and chroma.align(audio.limit(0), F.col("audio"), F.col("doc_id") > 0).count() == 0
