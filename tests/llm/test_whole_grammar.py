"""Re-Pair goes on until no pair is frequent."""

import numpy as np

from loomdex.llm import grammar


def left_over(s, sym_ends):
    inner = np.ones(len(s) - 1, bool)
    inner[sym_ends[:-1] - 1] = False
    key = (s[:-1].astype(np.uint64) << np.uint64(32)) | s[1:]
    return np.unique(key[inner], return_counts=True)


def test_grammar_leaves_no_frequent_pair():
    rng = np.random.default_rng(1)
    own = rng.integers(0, 400, 553).astype(np.uint32)
    copies = np.tile(own, 60)
    base, left, right, size, s, sym_ends = grammar.compress(copies, np.arange(1, 61) * 553)
    assert len(s) == 60 and size.max() == 553
    mixed = np.concatenate([rng.integers(0, 6, 40_000), np.repeat(7, 9), copies[:5_530]]).astype(np.uint32)
    ends = np.array([20_000, len(mixed)])
    base, left, right, size, s, sym_ends = grammar.compress(mixed, ends)
    key, n = left_over(s, sym_ends)
    assert (n[(key >> np.uint64(32)) != (key & np.uint64(0xFFFFFFFF))] < 8).all()
    shard = grammar.Shard.open(grammar.pack_shard([1, 2], mixed, ends))
    assert (shard.expand(0, len(shard.symbols)) == mixed).all()
