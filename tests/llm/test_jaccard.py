"""The pipeline's near-duplicate stage against all pairs of five-word shingle sets."""

import random
import re

import corpus_pipeline
import numpy as np

from loomdex.llm import jaccard, simhash
from loomdex.llm.components import components
from tests.llm.test_operators import DOC, brute_fp, groups


def brute_set(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())


def alike(a, b):
    return a == b or len(a & b) >= jaccard.LEAST * len(a | b)


def corpus():
    """Texts, copies with some words swapped (about 0.6 to 1 alike), a chain, a group over jaccard.SHORT, and a passage that most share."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    common = [word() for _ in range(30)]
    texts = []
    for k in range(25):
        t = [word() for _ in range(rng.randrange(8, 150))] + (common if k % 3 else [])
        texts.append(t)
        for _ in range(40 if k == 0 else rng.randrange(5)):
            c = list(rng.choice(texts[-3:]) if k == 1 else t)
            for _ in range(rng.randrange(1, 4)):
                c[rng.randrange(len(c))] = word()
            texts.append(c)
    return [" ".join(t) for t in texts] + ["a b", "A  b", "", None, "x y z q", "x y z"]


def test_no_pair_is_left(spark):
    texts = corpus()
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOC)
    sets, fps = [brute_set(t) for t in texts], [brute_fp(t) for t in texts]
    pairs = [(a, b) for b in range(len(texts)) for a in range(b) if alike(sets[a], sets[b]) or (fps[a] ^ fps[b]).bit_count() <= 2]
    want = {d for d, r in groups(pairs, range(len(texts))).items() if d == r}
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == want
    assert want < {r.doc_id for r in simhash.keep_one(docs).collect()}


def test_rows_without_an_id_of_their_own(spark):
    rows = [(None, "one text of its own"), (None, "another text that is unlike"), (None, "another text that is unlike"), (None, "a third one, unlike both"), (7, "seven words stand in this one text"), (7, "nothing in common with it at all here"), (8, "Seven words stand in this one text")]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], DOC)
    got = [(r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)["simhash"](spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted({*rows[:2], *rows[3:6]}, key=str)


def test_first_list_of_a_pair():
    """Pairs whose heads share a shingle are made in one list, others in every list that both are in."""
    rng = random.Random(3)
    top = np.iinfo(np.int64).max
    for _ in range(300):
        a, b = (sorted(rng.sample(range(-20, 20), rng.randrange(1, 25))) for _ in range(2))
        k = [rng.choice([2, 5]) for _ in range(2)]
        head = np.full((2, 5), top)
        for r, x in enumerate((a, b)):
            head[r, : min(k[r], len(x))] = x[: k[r]]
        shared = sorted(set(a) & set(b))
        if not shared:
            continue
        no = ~jaccard.earlier(head, np.zeros(len(shared), int), np.ones(len(shared), int), np.array(shared))
        both = set(a[: k[0]]) & set(b[: k[1]])
        assert [h for h, ok in zip(shared, no, strict=True) if ok] == ([min(both)] if both else shared)


def test_links_join_components(spark):
    link = lambda rows: spark.createDataFrame(rows, "a long, b long")
    first, later = [(1, 2), (3, 4), (5, 6)], [(2, 3), (9, 10), (4, 9), (11, 5)]
    got = jaccard._joined(components(link(first)), link(later)).collect()
    roots = groups(first + later, range(1, 12))
    assert sorted(r.node for r in got) == [1, 2, 3, 4, 5, 6, 9, 10, 11]
    assert all((a.root == b.root) == (roots[a.node] == roots[b.node]) for a in got for b in got)
