"""The pipeline against brute-force stages on the smallest tables."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from loomdex.llm import decontaminate, language, line_dedup
from loomdex.llm.queries import table
from tests.llm.test_operators import brute_fp, groups

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    bench = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    now, texts = docs, {k: r.text for k, r in rows.items()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, SF).write.parquet(f"file://{tmp_path}/{k}")
        now = spark.read.parquet(f"file://{tmp_path}/{k}")
        assert now.columns == docs.columns
        if name == "language_id":
            model = language.train(docs)
            mean = {d: np.mean(s, axis=0) for d, t in texts.items() if (s := [model.word(w) for w in re.findall(r"[^\W\d_]+", t.lower())])}
            n = {d: len(re.findall(r"[^\W\d_]+", t)) for d, t in texts.items()}
            top = lambda d: 1 / np.exp((mean[d] - mean[d].max()) * min(20, n[d])).sum()  # noqa: E731, B023
            texts = {d: t for d, t in texts.items() if d in mean and top(d) >= 0.3}
        elif name == "line_dedup":
            total, pages = Counter(rows[d].source for d in texts), Counter()
            for d, t in texts.items():
                pages.update({(rows[d].source, x.strip(" ")) for x in t.split("\n")})
            bad = lambda s, x: x.strip(" ") and pages[s, x.strip(" ")] >= line_dedup.MIN_PAGES and pages[s, x.strip(" ")] > line_dedup.MAX_SHARE * total[s]  # noqa: E731, B023
            texts = {d: "\n".join(x for x in t.split("\n") if not bad(rows[d].source, x)) for d, t in texts.items()}
        elif name == "simhash":
            fp = {d: brute_fp(t) for d, t in texts.items()}
            root = groups([(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2], set(fp))
            texts = {d: t for d, t in texts.items() if root[d] == d}
        else:
            texts = {d: t for d, t in texts.items() if not decontaminate.brute_force(t, bench)[-1]}
        assert {r.doc_id: r.text for r in now.collect()} == texts, name
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.select("doc_id").collect()} == set(texts)
    assert corpus_pipeline.ORACLE_SQL is None


def test_empty_and_null(spark):
    docs = table(spark, SF, "documents")
    for rows in (docs.limit(0), spark.createDataFrame([(1, None, None, None, None), (None, "a b", None, None, 3)], docs.schema)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, rows, SF).collect()


@pytest.mark.parametrize("gone", [["corpus_pipeline"], ["loomdex.llm"]])
def test_entry_point_without_them(gone, monkeypatch):
    import sys

    import __spark_entry__

    for name in gone:
        monkeypatch.setitem(sys.modules, name, None)
    assert not any(re.match(r"op\d+_|pipeline", n) for n in __spark_entry__.queries())
