"""The pipeline as a whole: planted cases, nulls, empty tables, clashing columns, labels of one class."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import decontam, minimax, mixing, oddsketch, toxicity
from loomgraph.plans.shared import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label int, shard int, node string"


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(n))


def corpus(rng):
    bad = ["vile", "scum", "filth", "hateful"]
    rows = []
    for i in range(120):
        words = prose(rng, 60).split()
        if i % 6 == 0:
            words[5:5] = rng.sample(bad, 3)
        rows.append((i, " ".join(words)))
    item = prose(rng, 40, "pqrstuv")
    near = rows[1][1].split()
    near[30] = "altered"
    rows += [(200, rows[1][1]), (201, " ".join(near)), (202, prose(rng, 20) + " " + item + " " + prose(rng, 20)), (203, None), (204, ""), (205, " \n "), (206, prose(rng, 30_000)), (207, "one"), (None, prose(rng, 30)), (3, rows[3][1])]
    return [(i, t, "en", ["s1", "s2", None][(i or 0) % 3], len(t or ""), 1, 2, "x") for i, t in rows], item


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top, (rows, item) = tmp_path_factory.mktemp("corpus"), corpus(random.Random(12))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, None, int(i % 6 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item), (None, ""), (2, None)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect() if r["doc_id"] is not None)


def test_stages_do_what_they_say(spark, folder):
    docs = table(spark, folder, "documents")
    calm = corpus_pipeline.toxicity_filter(spark, docs, folder)
    assert set(range(0, 120, 6)).isdisjoint(ids(calm)) and len(ids(calm)) > 95 and calm.columns == docs.columns
    single = corpus_pipeline.near_dedup(spark, docs, folder)
    assert set(ids(docs)) - set(ids(single)) == {200, 201} and single.columns == docs.columns
    clean = corpus_pipeline.decontaminate(spark, docs, folder)
    assert set(ids(docs)) - set(ids(clean)) == {202} and clean.columns == docs.columns
    mixed = corpus_pipeline.mix_sources(spark, docs, folder)
    assert mixed.columns == docs.columns and not mixed.isEmpty()
    sharded = corpus_pipeline.shard(spark, docs, folder)
    assert sharded.count() == docs.count()


def test_the_whole_is_the_stages_one_after_the_other(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    docs = table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    want = minimax.minimax_shards(docs)
    key = lambda df: sorted(str(r) for r in df.collect())
    assert key(out) == key(want)
    left = set(ids(out))
    assert {200, 201, 202}.isdisjoint(left) and set(range(0, 120, 6)).isdisjoint(left)


def test_empty_tables_and_labels_of_one_class(spark, tmp_path):
    rows, item = corpus(random.Random(12))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = "doc_id long, quality int, toxic int"
    for k, (d, given) in enumerate(((docs.limit(0), []), (docs, []), (docs, [(i, 1, 1) for i in range(4)]), (docs, [(i, 1, 0) for i in range(4)]))):
        top = f"{tmp_path}/{k}"
        d.write.parquet(f"{top}/documents.parquet")
        spark.createDataFrame(given, labels).write.parquet(f"{top}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
        kept = corpus_pipeline.toxicity_filter(spark, table(spark, top, "documents"), top)
        assert kept.count() == d.count()  # nothing is learnt, nothing goes
        scores = toxicity.toxicity(table(spark, top, "documents"), table(spark, top, "labels"))
        assert {r["score"] for r in scores.select("score").collect()} <= {0.5}
        if k != 3:
            corpus_pipeline.run(spark, top).collect()


def test_repeated_ids_give_one_example(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i % 20, prose(rng, 20) + (" vile scum" if i % 20 < 10 else ""), "x") for i in range(400)], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, 1, int(i < 10)) for i in range(20)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(docs.select("doc_id", "text"), labels.select("doc_id", F.col("toxic").cast("long").alias("label")))
    assert len(index.ids) == len(set(index.ids.tolist())) == 20
    assert decontam.without_leaks(docs, docs.limit(0).select(F.col("doc_id").alias("item_id"), "text")).count() == 400
    assert oddsketch.deduplicated(docs).count() == 400 and mixing.mixed_documents(docs.withColumn("source", F.lit("s"))).count() > 0
