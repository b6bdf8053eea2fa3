"""Golden mini-corpus, scalar cases and properties of the engine."""

import json
import random
import threading
import urllib.request
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from loomdex import serve
from loomdex.config import DEFAULT, STOP_WORDS
from loomdex.functions import analyzer, footprint, scoring, urls
from loomdex.functions.stemmer import stem
from loomdex.operators import crawl, documents, index, search
from loomdex.sources import html, robots, store
from loomdex.streaming import crawl_state

PAGES = "page_id long, url string, html string"
CORPUS = [
    (0, "http://h/u0", "<html><title>data lab</title><body><h1>data lab</h1><p>graph search</p></body></html>"),
    (1, "http://h/u1#x", "<html><title>graph</title><p>data data graph</p></html>"),
    (2, "http://h/u2", "<html><title>search</title><h2>data</h2><p>tree</p></html>"),
    (3, "http://h/u3", "<html><title>tree</title><p>tree tree ant</p></html>"),
    (4, "http://h/u4", "<html><title>ant</title><b>ant</b><p>graph data</p></html>"),
]
EXTRA = [(9, "http://h/u0#again", "<html><p>other words here</p></html>"), (10, "http://h/empty", "<html></html>")]


@pytest.fixture(scope="module")
def built(spark):
    return index.build(documents.build(spark.createDataFrame(CORPUS + EXTRA, PAGES)))


def one(spark, column, **row):
    cols = [F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in row.items()]
    return spark.range(1).select(*cols).select(column.alias("x")).first().x


def test_extents(spark):
    got = {r.page_id: r.extents for r in documents.extents(documents.extract(spark.createDataFrame(CORPUS, PAGES))).collect()}
    assert {k: {t: [tuple(e) for e in v] for t, v in m.items()} for k, m in got.items()} == {0: {"h1": [(0, 8)]}, 2: {"h2": [(0, 4)]}, 4: {"b": [(0, 3)]}}


UNIGRAMS = {
    "ant": [(4, [-1, 0], 26.2, 0.9623), (3, [10], 1, 0.3979)],
    "data": [(0, [-1, 0], 30, 0.2401), (2, [0], 3, 0.1431), (1, [0, 5], 2, 0.1261), (4, [10], 1, 0.0969)],
    "graph": [(1, [-1, 10], 26, 0.5358), (0, [9], 1, 0.2218), (4, [4], 1, 0.2218)],
    "lab": [(0, [-6, 5], 30, 1.7314)],
    "search": [(2, [-1], 25, 0.9542), (0, [15], 1, 0.3979)],
    "tree": [(3, [-1, 0, 5], 27, 0.9675), (2, [5], 1, 0.3979)],
}
BIGRAMS = {("ant graph", 4, 0.7543), ("data data", 1, 0.699), ("data graph", 1, 0.699), ("data lab", 0, 1.7314), ("data tree", 2, 1.0325), ("graph data", 4, 0.699), ("graph search", 0, 0.699), ("lab graph", 0, 1.1875), ("tree ant", 3, 0.699), ("tree tree", 3, 0.699)}


def test_postings(built):
    assert built.n_docs == 5
    rows = index.ranked(built.unigrams, 1, 99).orderBy("term", "rank").collect()
    got = {}
    for r in rows:
        got.setdefault(r.term, []).append((r.doc_id, r.positions, r.wtf, r.score))
    assert got == UNIGRAMS
    assert {(r.term, r.doc_id, r.score) for r in built.bigrams.collect()} == BIGRAMS


def test_posting_lines_round_trip(built):
    lines = index.encode(built.unigrams)
    assert lines.where("term = 'lab'").first().line == "lab:[17][0,[-6,5],1.7314]"
    key = lambda df: sorted((r.term, r.doc_id, r.positions, r.score) for r in df.collect())
    assert key(index.decode(lines)) == key(built.unigrams)


def ask(spark, built, *texts):
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, q string")
    out = {k: [] for k in range(len(texts))}
    for r in search.search(built, q).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.doc_id, r.score))
    return list(out.values())


def test_search(spark, built):
    graph, two, none, stop, unknown, cased, comma = ask(spark, built, "graph", "data graph", "", "the", "zzz", "The data", "graph, data")
    assert graph == [(1, 0.5358), (0, 0.2218), (4, 0.2218)]
    assert two == [(2, 0.1431), (1, 0.131), (0, 0.072), (4, 0.059)]
    assert none == stop == unknown == []
    assert [d for d, _ in cased] == [0, 2, 1, 4]
    # graph, with its comma has no query frequency, so data alone weighs the full matches
    assert comma[1:] == [(0, 0.023), (1, 0.012), (4, 0.009)]


def test_bigram_bonus_option(spark, built):
    more = replace(built, config=replace(DEFAULT, bigram_bonus=True))
    assert dict(ask(spark, more, "data graph")[0])[1] == pytest.approx(0.131 + 0.699)


def test_stop_word_queries_use_bigrams(spark):
    pages = [(0, "http://h/a", "<html><p>to be or not to be</p></html>"), (1, "http://h/b", "<html><p>be to</p></html>"), (2, "http://h/c", "<html><p>x y</p></html>")]
    ix = index.build(documents.build(spark.createDataFrame(pages, PAGES)))
    two, many = ask(spark, ix, "to be", "to be or")
    assert [d for d, _ in two] == [0] and two[0][1] > 0
    assert many[0] == (0, 0.0)


def test_ladder_equals_loop(spark):
    rng = random.Random(1)
    lists = {t: rng.sample(range(4000), rng.choice([5, 150, 900, 2500])) for t in ("aa", "bb", "cc")}
    rows = [(t, d, float(len(ds) - k), len(ds)) for t, ds in lists.items() for k, d in enumerate(ds)]
    post = spark.createDataFrame(rows, "term string, doc_id long, score double, df long")
    docs = spark.createDataFrame([(d, "", "", 10) for d in range(4000)], "doc_id long, title string, url string, n_tokens int")
    ix = index.Index(post, post.limit(0), docs, 4000, replace(DEFAULT, stem=False))
    asked = [["aa", "bb"], ["bb", "cc"], ["aa", "bb", "cc"], ["cc"]]
    q = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(asked)], "query_id long, q string")
    found = search.matches(ix, search.terms(search.parts(q, ix.config).where("level = 0"), ix.config)).collect()
    for k, words in enumerate(asked):
        for cut in DEFAULT.cutoffs:
            want = set.intersection(*[set(lists[w][:cut]) for w in words])
            if len(want) >= 10:
                break
        assert {r.doc_id for r in found if r.query_id == k} == want


@pytest.mark.parametrize(("text", "want"), [("Für A1-b", ["f", "r", "a1", "b"]), ("don't John's", ["do", "not", "john", "s"]), ("", []), ("''", []), ("can't stop", ["cannot", "stop"])])
def test_tokens(spark, text, want):
    assert one(spark, analyzer.tokens(F.col("t")), t=text) == want


def test_scalars(spark):
    assert one(spark, analyzer.positions("w"), w=["f", "r", "a1", "b"]) == [0, 2, 4, 7]
    assert [one(spark, scoring.title_position(F.col("p")), p=p) for p in (0, 5)] == [-1, -6]
    assert [one(spark, scoring.tf(F.col("f")), f=f) for f in (0, 1, 10)] == [0, 1, 2]
    assert [one(spark, analyzer.split_words(F.col("w"), F.lit(2), F.lit(k)), w=list("abcde")) for k in (0, 1)] == [list("abc"), list("de")]
    assert one(spark, urls.defrag(F.col("u")), u="http://h/p?q=1#x") == "http://h/p?q=1"
    assert one(spark, urls.sort_query(F.col("u")), u="http://h/p?b=2&a=1") == "http://h/p?a=1&b=2"
    assert one(spark, urls.sort_query(F.col("u")), u="http://h/p?b=2") == "http://h/p?b=2"
    assert one(spark, urls.path_repeats(F.col("u")), u="http://h/x/a/b/a/b/a/b/a/b") == ["a", "b"]
    assert one(spark, urls.path_repeats(F.col("u")), u="http://h/a/a/a") == []
    assert one(spark, urls.trap_prefix(F.col("u")), u="http://h/x/A/b/a/b/a/b/a/b") == "http://h/x"
    assert [one(spark, crawl.low_value(F.lit(a), F.lit(b))) for a, b in ((10, 4), (10, 5), (3, 149), (3, 150))] == [True, False, True, False]
    assert one(spark, analyzer.bigrams(F.col("w")), w=["a", "b", "c"]) == ["a b", "b c"]
    assert one(spark, analyzer.all_stop_words(F.col("w")), w=["The"]) is False
    assert "let" in STOP_WORDS


@pytest.mark.parametrize(("url", "ok"), [("http://a.example.com/x", True), ("ftp://example.com/", False), ("http://example.com.evil.org/", False), ("https://EXAMPLE.org/A.PDF", False), ("http://example.net/a.pdf?x", False), (None, False)])
def test_is_valid(spark, url, ok):
    assert spark.createDataFrame([(url,)], "u string").select(urls.is_valid(F.col("u")).alias("x")).first().x is ok


def test_resolve_survives_bad_links(spark):
    d = spark.createDataFrame([("http://h/a/b", ["c#x", "/d", "http://[bad", "mailto:x"])], "u string, l array<string>")
    assert d.select(urls.resolve("u", "l").alias("x")).first().x == ["http://h/a/c", "http://h/d", "mailto:x"]


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("filing", "file"), ("sky", "sky"), ("happy", "happi"), ("adoption", "adopt"), ("controll", "control"), ("roll", "roll"), ("is", "is")])
def test_stem(word, want):
    assert stem(word) == want


def test_html():
    p = html.parse("<html><head><title>T &amp; x</title><style>a</style></head><body>a<b>c</b><!-- no --><script>z</script><h1><a href='/q'>in</a></h1></body></html>", "http://h/p")
    assert p["title"] == "T & x" and p["links"] == ["/q"]
    assert [(e["tag"], e["text"]) for e in p["elems"]] == [("body", "a"), ("b", "c"), ("a", "in")]
    assert html.parse("just text", "http://h/d/f.txt")["elems"] == [{"tag": None, "text": "just text"}]
    assert html.parse("<p>no title</p>", "http://h/d/name.html")["title"] == "name.html"
    assert html.parse("<p>x</p>", "http://h/d/f.pdf")["is_html"] is False


def hamming(rows, i, j):
    a, b = rows[i], rows[j]
    close = bin(a[3] ^ b[3]).count("1") + bin(a[4] ^ b[4]).count("1") <= 1 and a[2] // 100 == b[2] // 100 and min(a[2], b[2]) / max(a[2], b[2]) > 0.975
    return close or a[1] == b[1]


@pytest.mark.parametrize("seed", range(4))
def test_dedup_equals_sequential_pass(spark, seed):
    rng = random.Random(seed)
    rows = [(k, f"u{rng.randrange(25)}", rng.choice([100, 150, 199, 200, 201]), 5 ^ (1 << rng.randrange(4)) * rng.randrange(2), 1 << rng.randrange(3)) for k in range(40)]
    kept = []
    for k in range(len(rows)):
        if not any(hamming(rows, i, k) for i in kept):
            kept.append(k)
    got = documents.kept_ids(spark.createDataFrame(rows, "page_id long, url string, n_tokens int, fp_hi long, fp_lo long"))
    assert sorted(r.page_id for r in got.collect()) == kept
    assert documents.kept_ids(spark.createDataFrame(rows, "page_id long, url string, n_tokens int, fp_hi long, fp_lo long").limit(0)).count() == 0


def test_footprint_ways_agree(spark):
    d = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["x"]), (3, ["x", "y"])], "doc_id long, w array<string>")
    counts = d.select("doc_id", F.explode("w").alias("token")).groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))
    a = {r.doc_id: (r.fp_hi, r.fp_lo) for r in footprint.footprints(counts).collect()}
    b = {r.doc_id: tuple(r.f) for r in d.select("doc_id", footprint.footprint("w").alias("f")).collect()}
    assert a == b


@pytest.mark.parametrize(("body", "path", "ok"), [("User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/x", False), ("User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/b/c", True), ("User-agent: *\nDisallow:", "/x", True), ("User-agent: *\nDisallow: /*.gif$", "/i/x.gif", False), ("User-agent: *\nDisallow: /*.gif$", "/i/x.gif2", True), ("User-agent: other\nDisallow: /", "/x", True), ("User-agent: *\nDisallow: /q?a", "/q?a=1", False), ("", "/", True)])
def test_robots(spark, body, path, ok):
    ruled = robots.rules(spark.createDataFrame([("h", 200, body)], "netloc string, status int, body string"))
    assert robots.can_fetch(spark.createDataFrame([(f"http://h{path}",)], "url string"), ruled).first().allowed is ok


def test_robots_policies(spark):
    ruled = robots.rules(spark.createDataFrame([("no", 403, None), ("gone", 404, None), ("d", 200, "User-agent: *\nCrawl-delay: 3\nRequest-rate: 1/5\nDisallow: /x\nSitemap: http://d/s.xml")], "netloc string, status int, body string"))
    got = {r.url: r.allowed for r in robots.can_fetch(spark.createDataFrame([("http://no/",), ("http://gone/",), ("http://new/",)], "url string"), ruled).collect()}
    assert got == {"http://no/": False, "http://gone/": True, "http://new/": True}
    a = robots.access(ruled).where("netloc = 'd'").first()
    assert (a.delay, a.requests, a.seconds, a.sitemaps) == (3, 1, 5, ["http://d/s.xml"])


def test_trap_rules(spark):
    d = spark.createDataFrame([("http://h/x/a/b/a/b/a/b/a/b",), ("http://h/x/y/c/c/c/c",), ("http://h/fine",)], "url string")
    got = {(r.pattern, r.temporary) for r in crawl.trap_rules(d).collect()}
    assert (r"^http://h/x.*$", False) in got
    assert not any(p.startswith(r"^http://h/x/y.*") and not t for p, t in got)


@pytest.mark.parametrize("limit", [10_000, -1])
def test_blacklist(spark, limit, monkeypatch):
    black = spark.createDataFrame([("r", r"^https?://m\..*$"), ("r", r"^http://h\.x/a\-b/?$")] + [("r", f"^http://none{k}$") for k in range(20)], crawl.BLACKLIST)
    if limit < 0:
        black = black.unionByName(spark.range(10_001).select(F.lit("r").alias("reason"), F.concat(F.lit("^http://q"), F.col("id").cast("string"), F.lit("$")).alias("pattern")))
    d = spark.createDataFrame([("http://m.h/",), ("http://h.x/a-b",), ("http://h.x/a-b/",), ("http://h.x/a-c",), ("http://q77",)], "url string")
    want = {"http://h.x/a-c", *(["http://q77"] if limit > 0 else [])}
    assert {r.url for r in crawl.blacklisted(d, black).collect()} == want


def test_query_trap_golden(spark):
    rows = [("h/p", "^http://h/p.*$", k, f"http://h/p?{k}", 7, 9) for k in range(1, 6)]
    d = spark.createDataFrame(rows, "path_key string, pattern string, page_id long, url string, fp_hi long, fp_lo long")
    got = [(r.suppressed, r.counter, r.pattern) for r in crawl_state.query_traps(d).orderBy("page_id").collect()]
    assert got == [(False, 0, None), (True, 1, None), (True, 2, None), (True, 3, "^http://h/p.*$"), (False, 0, None)]


def test_query_trap_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    schema = "path_key string, pattern string, page_id long, url string, fp_hi long, fp_lo long"
    rows = [(f"p{rng.randrange(3)}", "^x", k, f"u{k}", rng.choice([0, 1, (1 << 32) - 1]), 0) for k in range(60)]
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    seen = []
    for k in range(1, 4):  # a batch of files at a time, over restarts from the checkpoint
        src = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
        query = crawl_state.query_traps_stream(src).writeStream.foreachBatch(lambda b, n: seen.extend(map(tuple, b.collect()))).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    want = sorted(map(tuple, crawl_state.query_traps(spark.createDataFrame(rows, schema)).collect()))
    order = [r[1] for r in seen]
    if order == sorted(order):  # files came in the order they were written
        assert sorted(seen) == want
    assert len(seen) == len(want)


def test_crawl_and_frontier(spark):
    link = lambda *u: "<html>" + "".join(f"<a href='{x}'>w</a>" for x in u) + "<p>" + "word " * 200 + "</p></html>"
    pages = spark.createDataFrame([(1, "http://example.com/a", link("/b", "/c.pdf", "/x?b=1&a=2")), (2, "http://example.com/b", link("/a", "http://other.tld/")), (3, "http://example.com/x?a=2&b=1", link())], PAGES)
    frontier, stats, black = crawl.crawl(pages, spark.createDataFrame([("http://example.com/a/",)], "url string"), 4, 10)
    assert {(r.url, r.completed) for r in frontier.collect()} == {("http://example.com/a", True), ("http://example.com/b", True), ("http://example.com/x?a=2&b=1", True)}
    assert {r.url for r in stats.collect()} == {"http://example.com/a", "http://example.com/b", "http://example.com/x?a=2&b=1"}
    assert crawl.totals(frontier).first() == (3, 0)
    assert crawl.report(stats)["subdomains"].first() == ("example.com", 3)
    assert crawl.resume(frontier).count() == 0


def test_sources(spark, tmp_path):
    import tarfile

    (tmp_path / "j" / "d").mkdir(parents=True)
    (tmp_path / "j" / "d" / "p.json").write_text(json.dumps({"content": "<p>x</p>", "encoding": "utf-8", "url": "http://h/1"}))
    assert [(r.url, r.html) for r in store.read_json_pages(spark, f"file://{tmp_path}/j").collect()] == [("http://h/1", "<p>x</p>")]
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        t.add(tmp_path / "j" / "d" / "p.json", "p.json")
    assert [(r.url, r.html) for r in store.read_archives(spark, f"file://{tmp_path}/a.tar.gz").collect()] == [("http://h/1", "<p>x</p>")]
    pages = spark.createDataFrame(CORPUS, PAGES)
    docs = documents.build(pages)
    store.write_docs(docs, documents.extents(documents.extract(pages)), f"file://{tmp_path}/out")
    assert store.corpus_size(spark, f"file://{tmp_path}/out") == 5
    assert spark.read.parquet(f"file://{tmp_path}/out/texts").where("doc_id = 0").first().text == "data lab graph search "
    assert json.loads(store.doc_lines(docs.where("doc_id = 0")).first().line) == ["data lab", "http://h/u0", "4"]


def test_index_files_and_http(spark, built, tmp_path):
    index.write(built, f"file://{tmp_path}/ix")
    again = index.read(spark, f"file://{tmp_path}/ix")
    assert index.lookup(again.unigrams, ["lab"]).count() == 1
    plan = index.lookup(again.unigrams, ["lab"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan or "EqualTo(term" in plan
    assert serve.respond(spark, again, "/?x=1")[0] == 404 and serve.respond(spark, again, "/?q=") == (200, [])
    server = serve.serve(spark, again, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/?q=graph") as r:
        assert [t for t, _ in json.load(r)["results"]] == ["graph", "data lab", "ant"]
    server.shutdown()


def test_incremental_index(spark, tmp_path):
    spark.createDataFrame(CORPUS, PAGES).repartition(3).write.parquet(f"file://{tmp_path}/p")
    src = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/p")
    crawl_state.index_stream(src, f"file://{tmp_path}/ix", f"file://{tmp_path}/cp").awaitTermination()
    got = {(r.term, r.doc_id): r.score for r in crawl_state.read_index_stream(spark, f"file://{tmp_path}/ix").collect()}
    assert got == {(t, d): s for t, rows in UNIGRAMS.items() for d, _, _, s in rows}


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
