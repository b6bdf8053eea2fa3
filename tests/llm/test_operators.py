"""Each operator against a brute-force version, on small tables with nulls, empty and long texts, ties and clashing columns."""

import random
import re
import zlib
from collections import Counter, defaultdict
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomdex.llm import components, decontaminate, encode, grammar, language, line_dedup, link_graph, packing, pseudonyms, quantized, simhash, token_files
from loomdex.llm.queries import queries, table, tokenizer_file
from loomdex.llm.shards import CommitConflict, ShardStore

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "a", "A b\tc", "é à \u00a0b", "x\n\ny", "same text of a few words", "same text of a few words", "long " * 30_000, "<|endoftext|> in text", "0 1 2 ! ?"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, repeated rows, null ids, and columns named like the operators' own."""
    rows = [(k, t, "en" if k % 2 else None, None if k % 5 == 0 else f"s{k % 2}", 1, "mine", 7, "r") for k, t in enumerate(ODD)]
    rows += [rows[3], rows[3], (None, "null id", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC + ", fingerprint string, component_id int, n_words string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def groups(links, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    for links in ([], [(k, k + 1) for k in range(60)], [(0, k) for k in range(1, 50)], [(rng.randrange(90), rng.randrange(90)) for _ in range(70)] + [(5, 5), (None, 3)]):
        got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
        real = [(a, b) for a, b in links if a is not None and a != b]
        want = groups(real, {x for p in real for x in p})
        assert set(got) == set(want)
        assert len({(got[n], want[n]) for n in want}) == len(set(got.values())) == len(set(want.values()))


def brute_hosts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute_rule(host, path):
    fits = [(len(r.text), r.text, r.verdict) for r in link_graph.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits)[1:] if fits else (None, None)


def brute_rank(edges, seed, d=0.85, rounds=20):
    hosts = set(seed) | {x for e in edges for x in e}
    total, out = sum(seed.values()), defaultdict(float)
    for (a, _), n in edges.items():
        out[a] += n
    s = {h: seed.get(h, 0) / total for h in hosts}
    now = dict(s)
    for _ in range(rounds):
        came = defaultdict(float)
        for (a, b), n in edges.items():
            came[b] += now[a] * n / out[a]
        lost = 1 - sum(came.values())
        now = {h: (1 - d) * s[h] + d * (came[h] + lost * s[h]) for h in hosts}
    return now


def test_url_filter(spark):
    urls = ["http://A.Example.net/en/1", "http://example.net/de/1", "https://x.org/fr/2?u", "http://example.com/de/", "http://example.com", None, "no scheme", "http://net", "http://notnet/", "ftp://a.net#f/x", "http://É.org/fr/", "x://y://net/"]
    urls += [u for u in urls[:2]]
    rows = spark.createDataFrame([(k, u, None, "c") for k, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in link_graph.judge(rows).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        host, path = brute_hosts(u)
        rule, verdict = brute_rule(host, path)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), u
        assert got[k].verdict == verdict if verdict else got[k].verdict in ("allow", "block")
    assert link_graph.judge(rows.limit(0)).count() == 0


def test_propagation(spark):
    rng = random.Random(4)
    edges = Counter((f"h{rng.randrange(9)}", f"h{rng.randrange(9)}") for _ in range(40))
    edges = {e: n for e, n in edges.items() if e[0] != e[1]}
    good, bad = {"h0": 1.0, "h3": 1.0}, {"h5": 1.0, "lone": 1.0}
    seeds = spark.createDataFrame([(h, good.get(h, 0.0), bad.get(h, 0.0)) for h in {*good, *bad}], "host string, good double, bad double")
    links = spark.createDataFrame([(*e, n) for e, n in edges.items()], "src string, dst string, n long")
    got = {r.host: r for r in link_graph.propagate(links, seeds, tolerance=0.0).collect()}
    trust, distrust = brute_rank(edges, good), brute_rank({(b, a): n for (a, b), n in edges.items()}, bad)
    for h, r in got.items():
        assert r.trust == pytest.approx(trust.get(h, 0), abs=1e-9)
        assert r.distrust == pytest.approx(distrust.get(h, 0), abs=1e-9)
    # a page that links to a blocked host is blocked by the method, one that trusted pages link to is not
    page = lambda k, u, *to: (k, u, "".join(f"<a href='{x}'>" for x in to))
    pages = [page(1, "http://spam.net/a"), page(2, "http://farm.com/x", "http://spam.net/a", "//spam.net/b"), page(3, "http://good.org/fr/1", "http://fine.com/"), page(4, "http://fine.com/q", "/local"), page(5, "http://alone.com/")]
    judged = {r.page_id: (r.rule, r.verdict) for r in link_graph.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert judged == {1: ("net/", "block"), 2: (None, "block"), 3: ("org/fr/", "allow"), 4: (None, "allow"), 5: (None, "allow")}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(spark, name):
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(tokenizer_file(name)), encode.Encoder(tokenizer_file(name))
    texts = [*ODD, "  a", "a  b ", "a\n b", "a\nb\nc d", "\x01 a \x01b", "a\n", "\na", "don't  'll we've", "ﬁ \u0301x", "\x1c a\x1f b", "x<|endoftext|> y <|startoftext|>z"]
    texts += [r.text for r in table(spark, SF, "documents").select("text").limit(60).collect()]
    for _ in range(2):
        ids, off = own.encode(pa.array(texts, pa.string()))
        for k, t in enumerate(texts):
            assert ids[off[k] : off[k + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, t


def test_grammar_round_trip():
    rng = np.random.default_rng(0)
    for base in (5, 300, 50_000, 70_000):
        sizes = rng.integers(0, 60, 50)
        ends = np.cumsum(sizes)
        ids = rng.integers(0, 4, ends[-1]).astype(np.uint32) + np.uint32(base)
        blob = grammar.pack_shard([None, *range(49)], ids, ends, least=3)
        s = grammar.Shard.open(blob)
        assert s.doc_ids[0] is None and len(s.left) > 3 and len(s.symbols) < len(ids)
        assert (s.expand(0, len(s.symbols)) == ids).all()
        for k in range(50):
            doc = ids[ends[k] - sizes[k] : ends[k]]
            assert (s.document(k) == doc).all()
            for a, b in ((0, 3), (2, 9), (5, sizes[k]), (0, sizes[k])):
                assert (s.tokens(k, a, min(b, sizes[k])) == doc[a : max(a, min(b, sizes[k]))]).all()


def test_token_files(spark, odd, empty, tmp_path):
    from tokenizers import Tokenizer

    path, plain = f"file://{tmp_path}/t", Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    token_files.write_tokens(odd, path, tokenizer_file("byte_bpe_50k.json"), shard_tokens=2000)
    got = sorted(token_files.read_tokens(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    want = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    at = 0
    for g, w in zip(got, want, strict=True):
        ids = [*plain.encode(w.text or "", add_special_tokens=False).ids, 0]
        assert (g.doc_id, g.start, g.n_tokens, g.ids, g.ids_crc32) == (w.doc_id, at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.read_document(spark, path, 9, 5, 9) == [*plain.encode(ODD[9], add_special_tokens=False).ids][5:9]
    token_files.write_tokens(empty, f"{path}2", tokenizer_file("byte_bpe_50k.json"))
    assert token_files.read_tokens(spark, f"{path}2").count() == 0


@pytest.mark.parametrize("pass_chars", [decontaminate.PASS_CHARS, 300])
def test_decontaminate(spark, odd, empty, monkeypatch, pass_chars):
    monkeypatch.setattr(decontaminate, "PASS_CHARS", pass_chars)
    rng = random.Random(5)
    word = lambda: rng.choice(["ab", "é1", "c", "dd", "the", "x9"])
    items = {k: " ".join(word() for _ in range(n)) for k, n in ((1, 13), (2, 30), (10, 4), (11, 1), (3, 14))}
    items |= {4: items[2], 12: "!!"}
    bench = spark.createDataFrame([*items.items(), (None, "the the"), (5, None), (2, items[2])], "item_id long, text string")
    texts = [", ".join(word() for _ in range(rng.randrange(200))) for _ in range(40)]
    texts += [f"{items[2]} {items[1].upper()}", "." + items[3], items[10] * 2, items[11], None, "", items[2][5:]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("items", F.lit(1))
    leaks = decontaminate.find_leaks(docs, bench)
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.digest(leaks, n=leaks.columns[-3], runs=leaks.columns[-2], items=leaks.columns[-1]).collect()}
    for k, t in enumerate(texts):
        assert got[k] == decontaminate.brute_force(t, items), t
    assert decontaminate.find_leaks(odd, bench).count() == odd.count()
    assert decontaminate.find_leaks(empty, bench).count() == 0
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k in got if not got[k][-1]}
    assert decontaminate.decontaminate(odd, bench.limit(0)).count() == odd.count()


def brute_fp(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd, empty):
    for docs in (table(spark, SF, "documents"), odd):
        rows = docs.collect()
        want = [(r.doc_id, brute_fp(r.text)) for r in rows]
        fps = {f for _, f in want}
        root = groups([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2], fps)
        least = {}
        for d, f in want:
            if d is not None:
                least[root[f]] = min(d, least.get(root[f], d))
        got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_of("fp").alias("fp"), "component_id").collect()
        assert Counter(map(tuple, got)) == Counter((d, f"{f:016x}", least.get(root[f])) for d, f in want)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({d for d, f in want if d == least.get(root[f])})


def test_posting_lists_lose_no_link(spark):
    rng = random.Random(6)
    centre = [rng.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for c in centre for _ in range(250)}
    fps |= {centre[0] ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(a)} | {centre[0] ^ v for v in range(1 << 9)}
    links = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2]
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    got = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()]
    assert all((a ^ b).bit_count() <= 2 or groups(links, fps)[a] == groups(links, fps)[b] for a, b in got[:50])
    assert groups(got, fps) == groups(links, fps)


def test_language(spark, odd, empty):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language.train(docs)
    got = language.identify(docs, model)
    assert got.count() == docs.count()
    out = got.where(language.held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert out[0] > 0.97 and 0 <= out[1] <= out[2] <= 1
    assert docs.where(language.held_out(F.col("doc_id"))).count() == sum(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in docs.select("doc_id").collect())
    assert model.predict(pa.array(["\u00b2 \u00bd 7 _", "e\u0301t\u00e9", None]))[0][0::2] == ["und", "und"]
    told = language.identify(odd, model).collect()
    assert all((r.lang_pred == "und" and r.score == 0) == (not re.search(r"[^\W\d_]", r.text or "")) for r in told)
    assert [r.lang_pred for r in language.identify(odd, language.train(empty)).select("lang_pred").distinct().collect()] == ["und"]
    assert language.identify(empty, model).count() == 0
    assert language.reject(odd, model).columns == odd.columns
    # words that were never seen fall back to n-grams, longer ones first
    m = language.Model(["a", "b"], {"schmitz": np.array([9, 0]), "eaux": np.array([0, 9])})
    assert m.word("schmitzen").argmax() == 0 and m.word("xeau").argmax() == 1 and (m.word("q") == m.word("q")).all()
    texts = [r.text for r in docs.limit(30).collect()]
    for t, (lang, _) in zip(texts, zip(*model.predict(pa.array(texts))), strict=True):
        s = np.mean([model.word(w) for w in re.findall(r"[^\W\d_]+", t.lower())], axis=0)
        assert model.langs[int(s.argmax())] == lang


def py_string(s, key, tweak):
    import hashlib

    cut = len(s) // 2
    halves = [s[:cut], s[cut:]]
    for r in range(pseudonyms.ROUNDS):
        me, other, out = halves[r % 2], halves[1 - r % 2], ""
        for i, c in enumerate(me):
            h = hashlib.sha256(f"{key}|{tweak}|{r}|{i // 32}|{other}".encode()).hexdigest()
            step = int(h[i % 32 * 2 : i % 32 * 2 + 2], 16)
            a = next((a for a in pseudonyms.ALPHABETS if c in a), None)
            out += a[(a.index(c) + step) % len(a)] if a else c
        halves[r % 2] = out
    return "".join(halves)


def py_pair(a, b, na, nb, key, tweak):
    import hashlib

    h = lambda r, x: int(hashlib.sha256(f"{key}|{tweak}|{r}|{x}".encode()).hexdigest()[:12], 16)
    for r in range(pseudonyms.ROUNDS):
        a, b = ((a + h(r, b) % na) % na, b) if r % 2 == 0 else (a, (b + h(r, a) % nb) % nb)
    return a, b


def luhn(d):
    return sum(v - 9 if v > 9 else v for k, c in enumerate(reversed(d)) for v in [int(c) * (1 + k % 2)]) % 10 == 0


def test_pseudonyms(spark, odd, empty):
    card = "4111111111111111"
    body = py_string(card[:15], "k", "card")
    new = next(body + c for c in "0123456789" if luhn(body + c))
    phone = py_string("0175557713", "k", "phone")
    a, b = py_pair(233 * 256 + 254, 104 * 256 + 120, 65536, 65536, "k", "ipv4")
    n = (date(2020, 2, 29) - date(1900, 1, 1)).days
    x, y = py_pair(n // 292, n % 292, 250, 292, "k", "date")
    day = date(1900, 1, 1) + timedelta(x * 292 + y)
    texts = {
        f"a {card} b": f"a {new} b",
        "4111 1111 1111 1111!!": f"{new[:4]} {new[4:8]} {new[8:12]} {new[12:]}!!",
        "4111111111111112 4111111111111113": "4111111111111112 4111111111111113",
        "x +1 (017) 555-7713": f"x +1 ({phone[:3]}) {phone[3:6]}-{phone[6:]}",
        "233.254.104.120": f"{a // 256}.{a % 256}.{b // 256}.{b % 256}",
        "299.1.1.1 1.2.3 2020-02-30 31/02/2001 000-12-3456": "299.1.1.1 1.2.3 2020-02-30 31/02/2001 000-12-3456",
        "on 2020-02-29, 29/2/2020 and 29.02.2020": f"on {day}, {day:%d/%m/%Y} and {day:%d.%m.%Y}",
        "123-45-6789": (s := py_string("123456789", "k", "ssn"))[:3] + "-" + s[3:5] + "-" + s[5:],
        "é.ß68@mail7.example.com": py_string("é.ß68", "k", "email") + "@mail7.example.com",
        "CC BY 4.0. version 3.": "CC BY 4.0. version 3.",
    }
    docs = spark.createDataFrame([(t, "mine") for t in texts], "text string, n_values string")
    got = pseudonyms.pseudonymise(docs, "k").collect()
    assert [r.text for r in got] == list(texts.values())
    assert got[0]["_n_values"] == 1
    for docs in (odd, empty):
        out = pseudonyms.pseudonymise(docs, "k")
        assert Counter(r.text for r in out.collect()) == Counter(r.text for r in docs.collect())
    # different values of one kind get different pseudonyms
    many = spark.range(3000).select(F.concat(F.lit("10.0."), (F.col("id") / 256).cast("int").cast("string"), F.lit("."), (F.col("id") % 256).cast("string")).alias("text"))
    assert pseudonyms.pseudonymise(many, "k").select("text").distinct().count() == 3000
    plan = pseudonyms.pseudonymise(odd, "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 16))
    near = np.concatenate([base[:40] + 0.15 * rng.normal(size=(40, 16)) for _ in range(4)] + [base[:1] + 0.01 * rng.normal(size=(90, 16))])
    x = np.concatenate([base, near, base[:20], base[:20] * 3]).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    bad = [(9000, None), (9001, [0.0] * 16), (9002, [None] * 16), (9003, [float("nan")] * 16), (9004, [float("inf")] * 16), (9005, []), (9006, [1.0] * 3)]
    d = spark.createDataFrame([(*r, "z") for r in rows + bad], "vec_id long, embedding array<float>, n_links string")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    got = {r.vec_id: r for r in quantized.embedding_duplicates(d).collect()}
    assert len(got) == len(rows) + len(bad)
    assert sum(got[k].n_links for k in range(len(x))) >= 0.99 * s.sum()
    assert all(got[k].n_links <= s[k].sum() for k in range(len(x)))
    want = groups([(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(s)), strict=True)], range(len(x)))
    assert np.mean([got[k].component_id == want[k] and got[k].kept == (want[k] == k) for k in range(len(x))]) > 0.98
    assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, True) for k, _ in bad)
    assert quantized.embedding_duplicates(d.limit(0)).count() == 0


def test_plan_places_every_piece():
    rng = np.random.default_rng(1)
    for lengths in (np.clip(rng.lognormal(6.2, 1.1, 20_000).astype(int), 1, 4096), rng.integers(1, 4097, 5000), rng.integers(1500, 2500, 999), np.array([4096, 4096, 2048, 2049, 1, 1]), np.array([7])):
        count = Counter(lengths.tolist())
        plan = packing.best_plan(count)
        lengths = np.sort(lengths)
        rank = np.arange(len(lengths)) - np.searchsorted(lengths, lengths)
        seq, at = packing.place(plan.table(), lengths, rank)
        order = np.lexsort((at, seq))
        s, a, n = seq[order], at[order], lengths[order]
        new = np.concatenate([[True], s[1:] != s[:-1]])
        assert (a[new] == 0).all() and (new[1:] | (a[1:] == a[:-1] + n[:-1])).all() and (a + n <= 4096).all()
        bound = max(-(-lengths.sum() // 4096), (lengths > 2048).sum() + -(-max(0, (lengths == 2048).sum()) // 2))
        assert len(np.unique(seq)) <= 1.15 * bound + 2
    assert len(np.unique(packing.place(packing.Plan({4096: 1, 2048: 2, 1: 4000}).table(), np.array([4096, 2048, 2048, *[1] * 4000]), np.array([0, 0, 1, *range(4000)]))[0])) == 3


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    got = packing.pack(odd.repartition(3), tokenizer_file("word_bpe_49k.json"), keep_ids=True).collect()
    want = Counter()
    for r in odd.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            want[(r.doc_id, k // 4096, k, tuple(ids[k : k + 4096]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == want
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(empty, tokenizer_file("word_bpe_49k.json")).count() == 0


def test_shards(spark, odd, empty, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, fan_in=3)
    with pytest.raises(FileNotFoundError):
        store.read()
    for k in range(7):
        store.append(odd.repartition(2))
    store.append(odd.limit(0))
    n, before = 7 * odd.count(), len(store.runs())
    assert store.read().count() == n and store.read(3).count() == 3 * odd.count()
    old = store.manifest()["version"]
    with pytest.raises(CommitConflict):
        store._commit(old - 1, None, [])
    assert store.compact(finish=True) > old
    assert len(store.runs()) < before / 3
    key = lambda df: Counter(map(tuple, df.collect()))
    assert key(store.read()) == Counter({k: 7 * v for k, v in key(odd).items()})
    again = ShardStore(spark, f"file://{tmp_path}/e")
    again.append(empty)
    again.compact(finish=True)
    assert again.read().count() == 0
    # files of a job that never committed are not read
    store._write(odd)
    assert store.read().count() == n
    store.vacuum()
    assert store.read().count() == n


@pytest.mark.parametrize("rows", [line_dedup.BROADCAST_ROWS, -1])
def test_line_dedup(spark, odd, empty, monkeypatch, rows):
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", rows)
    data = [(k, f"menu \nown {k}\n\nmenu\nfew" if k % 7 == 0 else f"menu\nown {k}", "a" if k % 3 else "b") for k in range(90)]
    data += [(100, "menu", None), (101, None, "a"), (102, "", "a"), (103, "menu\nx", "small")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("_keys", F.lit(3))
    got = {r.doc_id: r for r in line_dedup.drop_lines(docs, max_share=0.2, min_pages=5, n_lines="n", n_dropped="gone").collect()}
    total, pages = Counter(s for _, _, s in data if s), Counter()
    for _, t, s in data:
        pages.update({(s, x.strip(" ")) for x in (t or "").split("\n")} if s else ())
    for k, t, s in data:
        if t is None:
            assert got[k].text is None and got[k].n == got[k].gone == 0
            continue
        keep = [x for x in t.split("\n") if not (s and x.strip(" ") and pages[s, x.strip(" ")] >= 5 and pages[s, x.strip(" ")] > 0.2 * total[s])]
        assert (got[k].text, got[k].n, got[k].gone) == ("\n".join(keep), len(t.split("\n")), len(t.split("\n")) - len(keep))
    assert line_dedup.drop_lines(odd).columns == odd.columns and line_dedup.drop_lines(odd).count() == odd.count()
    assert line_dedup.drop_lines(empty).count() == 0


def test_queries_return_every_row(spark):
    n = {t: table(spark, SF, t).count() for t in ("documents", "pages", "embeddings")}
    for name, q in queries().items():
        df = q(spark, SF)
        if name == "op8_packing":
            assert df.select("doc_id").distinct().count() == n["documents"]
        else:
            assert df.count() == n[{"op1": "pages", "op7": "embeddings"}.get(name.split("_")[0], "documents")], name
