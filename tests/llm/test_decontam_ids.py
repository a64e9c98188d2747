"""Benchmark texts with repeated and missing ids."""

from loomgraph.llm import decontam


def test_every_text_of_an_id_counts_and_ids_may_be_missing(spark):
    texts = ["one fine day the fox ran over the hill", "seven grey stones lay by the old river", "no cat ever swam across that wide lake"]
    benchmark = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2])], "item_id long, text string")
    docs = spark.createDataFrame([*enumerate(texts), (3, "nothing of this is known")], "doc_id long, text string")
    got = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in decontam.contamination(docs, benchmark).collect()}
    assert got == {0: [1], 1: [1], 2: [None], 3: []}
    assert [r["doc_id"] for r in decontam.without_leaks(docs, benchmark).collect()] == [3]
