"""Tallies that decide, vectors of any dimension and scale, writers at one time, and language counts made anew."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomdex.llm import language, quantized, simhash
from loomdex.llm.shards import ShardStore


def signed(f):
    return f - (1 << 64) if f >> 63 else f


def test_tally_drops_pairs_that_share_too_few_bytes(spark):
    """Three bytes apart: five are shared, so the pair meets, and its tally is one."""
    a = 0x0123456789ABCDEF
    b, c = a ^ 0x010101, a ^ 0x0101
    rows = spark.createDataFrame([(signed(x),) for x in (a, b, c)], "fp long")
    met = simhash._masked(rows, 5).repartition("k", "bytes").sortWithinPartitions("k", "bytes").mapInArrow(simhash._meetings, "a long, b long")
    n = {(r.a, r.b): r["count"] for r in met.groupBy("a", "b").count().collect()}
    pair = lambda x, y: (min(signed(x), signed(y)), max(signed(x), signed(y)))
    assert n[pair(a, b)] == 1 and n[pair(a, c)] == 6
    assert {(r.a, r.b) for r in simhash.links(rows).collect()} == {pair(a, c), pair(b, c)}


def test_meetings_over_batches():
    """Lists that go on over batches are paired once, long ones give their members once."""
    import pyarrow as pa

    rng = random.Random(2)
    lists = [(k, [rng.getrandbits(40) for _ in range(n)]) for k, n in enumerate([1, 2, 16, 17, 40, 3, 1, 5])]
    rows = [(k, k, f) for k, fps in lists for f in fps]
    for size in (1, 2, 7, 100):
        batches = [pa.RecordBatch.from_pydict({"k": pa.array([r[0] for r in rows[i : i + size]], pa.int8()), "bytes": pa.array([r[1] for r in rows[i : i + size]]), "fp": pa.array([r[2] for r in rows[i : i + size]])}) for i in range(0, len(rows), size)]
        got = Counter((a, b) for out in simhash._meetings(iter(batches)) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True))
        want = Counter()
        for _, fps in lists:
            if len(fps) > simhash.SHORT:
                want.update((f, None) for f in fps)
            else:
                want.update((min(x, y), max(x, y)) for i, x in enumerate(fps) for y in fps[:i])
        assert got == want


@pytest.mark.parametrize("tile", [quantized.TILE, 64])
def test_vectors_of_any_dimension_and_scale(spark, monkeypatch, tile):
    monkeypatch.setattr(quantized, "TILE", tile)
    monkeypatch.setattr(quantized, "LIST_VECTORS", 8)  # two levels of lists
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(60, 24))
    x = np.concatenate([centre + s * rng.normal(size=centre.shape) for s in (0, 0.1, 0.15, 0.2, 0.25)] + [centre[:1] + 0.05 * rng.normal(size=(150, 24))])
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    other = [(1000, [1.0, 0.0, 0.0]), (1001, [2.0, 0.0, 0.0]), (1002, [1e200, 1e200]), (1003, [2e200, 2e200]), (1004, [1e-200, 0.0]), (1005, [2e-200, 0.0]), (None, [1.0, 0.0, 0.0]), (1000, [0.0, 1.0, 0.0])]
    got = quantized.embedding_duplicates(spark.createDataFrame(rows + other, "vec_id long, embedding array<double>"), probes=6).collect()
    assert len(got) == len(rows) + len(other)
    by = {r.vec_id: r for r in got if r.vec_id is not None and r.vec_id != 1000}
    s = quantized.unit(x) @ quantized.unit(x).T >= 0.9
    np.fill_diagonal(s, False)
    found = sum(by[k].n_links for k in range(len(x)))
    assert 0.9 * s.sum() <= found <= s.sum() and all(by[k].n_links <= s[k].sum() for k in range(len(x)))
    assert (by[1001].n_links, by[1001].component_id) == (2, 1000) and [by[k].n_links for k in (1002, 1003, 1004, 1005)] == [1] * 4
    assert sorted((r.n_links, r.component_id) for r in got if r.vec_id == 1000) == [(0, 1000), (2, 1000)]


def test_keep_one_loses_no_text(spark):
    rows = [(None, "one"), (None, "two"), (None, "three"), (5, "four of them"), (5, "five of them")]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(got, key=str) == sorted(rows, key=str)


def test_two_writers(spark, tmp_path):
    """A writer whose data is not committed yet loses nothing to a compaction, and a commit that is overtaken is tried again."""
    path = f"file://{tmp_path}/s"
    a, b = ShardStore(spark, path, fan_in=2), ShardStore(spark, path, fan_in=2)
    d = spark.range(10).selectExpr("id", "string(id) as t")
    for _ in range(4):
        a.append(d.coalesce(1))
    old = a.read()
    with b._writing() as name:
        new = b._write(d.coalesce(1), name)
        a.compact(finish=True, grace=0, keep=9)
        now = b.manifest()
        a.append(d.coalesce(1))
        with pytest.raises(RuntimeError):
            b._commit(now["version"], now["schema"], [*b.runs(now["version"]), *new])
        b._commit(b.manifest()["version"], now["schema"], [*b.runs(), *new])
    assert a.read().count() == 60 and old.count() == 40
    with pytest.raises(ValueError):
        a.append(d.withColumn("more", d.id))
    a.compact(finish=True, grace=0)
    assert b.read().count() == 60


def test_language_counts_made_anew(spark):
    """Training, log frequencies and backoff by plain counting."""
    texts = [("en", "the cat and the dog, the end"), ("en", "a dog ran"), ("de", "der Hund und die Katze"), ("de", "das Ende und der Anfang"), (None, "nobody's words"), ("en", None)]
    rows = [(k, t, lang, 1, 2) for k, (lang, t) in enumerate(texts * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, `a.b` int")
    model = language.train(docs)
    words = defaultdict(Counter)
    for k, t, lang, *_ in rows:
        if t and lang and zlib.crc32(str(k).encode()) % 3 != 1:
            words[lang].update(re.findall(r"[^\W\d_]+", t.lower()))
    langs = sorted(words)
    assert model.langs == langs

    def table(count):
        names = set().union(*count.values())
        return {g: [math.log((count[x][g] + 0.1) / (sum(count[x].values()) + 0.1 * len(names))) for x in langs] for g in names}

    known, gram = table(words), {}
    for n in range(1, 6):
        count = {x: Counter() for x in langs}
        for x in langs:
            for w, k in words[x].items():
                f = f"<{w}>"
                for i in range(len(f) - n + 1):
                    count[x][f[i : i + n]] += k
        gram[n] = table(count)

    def score(w):
        if w in known:
            return known[w]
        for n in range(5, 0, -1):
            f = f"<{w}>"
            if found := [gram[n][f[i : i + n]] for i in range(len(f) - n + 1) if f[i : i + n] in gram[n]]:
                return np.mean(found, axis=0)
        return [0.0] * len(langs)

    some = ["the", "katze", "hunde", "dogs", "qqq", "endet", "x"]
    assert np.allclose(model.score_words(some), [score(w) for w in some], atol=1e-4)
    assert np.allclose([model.word(w) for w in some], [score(w) for w in some], atol=1e-4)
    told = language.identify(docs, model)
    assert told.columns == ["doc_id", "text", "lang", "score", "a.b", "lang_pred", "_score"]
    for r in told.collect():
        if r.text:
            mean = np.mean([score(w) for w in re.findall(r"[^\W\d_]+", r.text.lower())], axis=0)
            assert r.lang_pred == langs[int(np.argmax(mean))]
    assert language.reject(docs, model).columns == docs.columns
