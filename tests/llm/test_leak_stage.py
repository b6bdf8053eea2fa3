"""The pipeline's decontamination stage drops documents with any benchmark passage, however long they are, and no others."""

import random

import corpus_pipeline

from tests.llm.test_operators import DOC


def test_a_passage_in_a_long_text(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(100_000)}"
    item = [word() for _ in range(40)]
    spark.createDataFrame([("i1", " ".join(item)), (None, "no id"), ("i2", None)], "item_id string, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    long = [word() for _ in range(2_000)]
    texts = [" ".join(long[:900] + item[5:18] + long[900:]), " ".join(long), " ".join(long[:900] + item[5:17] + long[900:]), None, ""]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOC).withColumnRenamed("source", "a.b")
    stage = dict(corpus_pipeline.STAGES)["decontamination"]
    got = stage(spark, docs, f"file://{tmp_path}")
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == {1, 2, 3, 4}
