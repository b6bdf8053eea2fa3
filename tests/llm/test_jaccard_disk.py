"""What the pipeline's near-duplicate stage moves and leaves on disk."""

import random
from pathlib import Path

import corpus_pipeline
import numpy as np

from loomdex.llm import jaccard
from loomdex.runtime import shared_dir
from tests.llm.test_jaccard import corpus
from tests.llm.test_operators import DOC


def test_members_without_a_partner_go():
    rng = random.Random(5)
    for _ in range(200):
        rows = sorted((rng.randrange(4), rng.randrange(1, 60), rng.randrange(3)) for _ in range(rng.randrange(1, 30)))
        rows = [(-1, 1, 0), *rows, (9, 1, 0)]  # the first and the last run stay
        h, n, root = (np.array(x) for x in zip(*rows, strict=True))
        like = lambda a, b: a[0] == b[0] and a[2] != b[2] and min(a[1], b[1]) >= jaccard.LEAST * max(a[1], b[1])
        want = [k in (0, len(rows) - 1) or any(like(a, b) for b in rows) for k, a in enumerate(rows)]
        assert jaccard.partnered(h, n.astype(float), root, jaccard.LEAST).tolist() == want


def test_fine_tallies():
    rng = np.random.default_rng(4)
    for n in (100, 2_049, 9_000, 40_000):
        x = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for share, m in ((0, n), (0.5, n), (0.9, n), (0.9, int(n * 0.95)), (0.95, int(n * 1.05))):
            same = int(share * min(n, m))
            y = np.concatenate([x[:same], rng.integers(0, 1 << 63, m - same).astype(np.uint64)])
            ok = jaccard.finely_alike(jaccard.fine_tally(x), jaccard.fine_tally(y), n + m, jaccard.LEAST)
            assert ok or same < jaccard.LEAST * (n + m - same)
            if share == 0 and n > 9_000:
                assert not ok and jaccard.alike(*(np.frombuffer(jaccard.tally(z), np.uint8)[None] for z in (x, y)), np.array([n + m]), jaccard.LEAST).all()


def test_what_a_stage_leaves(spark):
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(corpus())], DOC)
    folder = Path(shared_dir(spark).removeprefix("file://")) / "loomdex"
    before = set(folder.glob("*"))
    dict(corpus_pipeline.STAGES)["simhash"](spark, docs, "").collect()
    left = {p.name.rpartition("-")[0] for p in set(folder.glob("*")) - before}
    assert "kept" in left and not left & {"marked", "marks", "nodes", "sketches", "lists", "apart", "candidates", "sets"}
