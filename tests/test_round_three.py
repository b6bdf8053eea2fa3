"""Findings of the third round."""

import duckdb
import pytest

import __spark_entry__


@pytest.fixture
def folder(spark, tmp_path):
    """A folder of small tables: write(name, rows, schema) adds one."""

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"file://{tmp_path}/{name}.parquet")

    write.path = str(tmp_path)
    return write


def same_as_sql(spark, path, name, tables):
    """The query's rows are its SQL's, in any order."""
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from read_parquet('{path}/{t}.parquet/*.parquet')")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = __spark_entry__.queries()[name](spark, path)
    assert got.columns == names
    key = lambda r: tuple(str(x) for x in r)
    mine, theirs = sorted((tuple(r) for r in got.collect()), key=key), sorted(want.fetchall(), key=key)
    assert mine == theirs
    return mine


PAGES = "page_id long, url string, html string"


def test_fetch_status_of_a_store_with_a_url_twice(spark, folder):
    folder("pages", [(1, "http://a.example.com/x", "old"), (2, "http://a.example.com/x", "new"), (3, "http://a.example.com/y#top", "y"), (4, "http://a.example.com/z", None)], PAGES)
    assert len(same_as_sql(spark, folder.path, "fetch_status", ["pages"])) == 4
    from loomdex.sources.store import fetch

    pages = spark.read.parquet(f"{folder.path}/pages.parquet")
    got = {(r.url, r.content) for r in fetch(pages.select("url").distinct(), pages).collect()}
    assert got == {("http://a.example.com/x", "old"), ("http://a.example.com/y#top", "y"), ("http://a.example.com/z", None)}


def test_page_titles_of_cut_references(spark, folder):
    page = "<html><head><title>{}</title></head><body>x</body></html>".format
    folder("pages", [(k, f"http://a.example.com/{k}", page(t)) for k, t in enumerate(["a &amp; b&amp", "x = &quot;y", " &lt;b&gt; &#39;q&#39; &amp;lt; ", ""])], PAGES)
    same_as_sql(spark, folder.path, "page_titles", ["pages"])


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["The cat, the CAT and the dog's cat sat.", "the cat\n\nsat on the mat\nthe cat sat", "", None, "at 7 o'clock", "a", "é the cat é sat"]


@pytest.fixture
def docs(folder):
    folder("documents", [(k + 3, t, "en", "the.example.com", len(t or "")) for k, t in enumerate(TEXTS)], DOCS)
    folder("benchmark", [(0, "the cat sat on the mat"), (1, "the and of"), (2, "clock dog cat"), (3, "")], "item_id long, text string")
    return folder.path


def plan(spark, path, name):
    return __spark_entry__.queries()[name](spark, path)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["bigram_freq", "bigram_positions", "weighted_postings", "token_positions", "simhash"])
def test_a_document_is_counted_where_it_lies(spark, docs, name):
    """Without a shuffle by document or term, a sort or lists that are collected."""
    made = plan(spark, docs, name)
    assert "hashpartitioning" not in made and "Aggregate" not in made and "Sort" not in made and "ArrowEvalPython [pandas" not in made
    if name != "weighted_postings":
        same_as_sql(spark, docs, name, ["documents"])


@pytest.mark.parametrize("name", ["posting_lines", "posting_decode"])
def test_posting_lines_take_one_shuffle(spark, docs, name):
    made = plan(spark, docs, name)
    assert made.count("hashpartitioning") == 1 and "collect_list" not in made and "Join" not in made
    same_as_sql(spark, docs, name, ["documents"])


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_lines_across_batches(spark, size):
    """A list that several batches for Python hold is one line."""
    from loomdex.operators import index

    rows = [(f"t{k // 5}", k, [k, k + 1], 0.5) for k in range(23)] + [("u", 99, [1], 1.0)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        d = spark.createDataFrame(rows, "term string, doc_id long, positions array<int>, score double")
        got = {r.term: r.line for r in index.encode(d, 2).collect()}
        back = sorted(tuple(r) for r in index.decode(index.encode(d, 2)).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert back == sorted(rows) and len(got) == 6 and got["u"] == "u:[12][99,[1],1.0]"


@pytest.mark.parametrize("name", ["and_query", "cutoff_ladder", "cosine_rank", "phrase_bonus", "relaxed_search"])
def test_the_index_has_the_terms_that_are_asked_for(spark, docs, name):
    from loomdex.plans import catalog

    same_as_sql(spark, docs, name, ["documents", "benchmark"])
    ix = catalog._index(spark, docs)
    assert {r.term for r in ix.unigrams.collect()} == {"cat", "sat", "dog", "clock"}
    assert {r.term for r in ix.bigrams.collect()} <= {"the cat", "cat sat", "sat on", "on the", "the mat", "dog cat", "the and", "and of", "clock dog"}


def test_tfidf_makes_postings_once(spark, docs):
    same_as_sql(spark, docs, "tfidf", ["documents"])
    assert plan(spark, docs, "tfidf").count("MapInArrow") == 0  # made and stored before


def test_vocabulary_by_partitions_that_grow(spark, docs, monkeypatch):
    from loomdex.plans import catalog

    assert same_as_sql(spark, docs, "vocabulary", ["documents"])
    monkeypatch.setattr(catalog, "PART_BYTES", 8)
    assert catalog._parts(spark, docs) > 100
    made = plan(spark, docs, "vocabulary")
    assert f"term#{made.split('hashpartitioning(')[1].split('term#')[1].split(',')[0]}, {catalog._parts(spark, docs)})" in made


def test_slices_are_whole(spark):
    """Long documents, more than a worker takes at a time, give what one pass over each gives."""
    from collections import Counter

    from loomdex.functions import tally

    rows = [(k, [f"w{(i * i + k) % 97}" for i in range(n)]) for k, n in enumerate([0, 5, 3000, 1, 2, 7000, 0, 40])]
    old, tally.TOKENS = tally.TOKENS, 1000
    try:
        d = spark.createDataFrame(rows, "doc_id long, words array<string>").coalesce(1)
        got = {(r.doc_id, r.term): r for r in tally.postings(d, (1, 2)).collect()}
    finally:
        tally.TOKENS = old
    from loomdex.functions.stemmer import stem

    want = Counter((k, stem(w)) for k, ws in rows for w in ws) + Counter((k, f"{stem(a)} {stem(b)}") for k, ws in rows for a, b in zip(ws, ws[1:], strict=False))
    assert {k: r.n for k, r in got.items()} == want
    assert all(len(r.positions) == r.n == r.wtf and r.positions == sorted(r.positions) for r in got.values())


def test_pages_are_parsed_in_one_pass(spark, folder, monkeypatch):
    """One map of a worker a task parses and joins links, block by block, with the same rows as in one block."""
    from loomdex.operators import documents
    from loomdex.sources import html

    rows = [(k, f"http://a.example.com/{k}#x" if k % 7 else None, f"<html><title>t{k}</title><p>{'word ' * k}</p><a href='b/{k}#y'>b</a><a href='http://['>c</a></html>" if k % 5 else None) for k in range(40)]
    d = spark.createDataFrame(rows, PAGES).coalesce(1)
    got = documents.extract(d)
    made = got._jdf.queryExecution().executedPlan().toString()
    assert made.count("MapInArrow") == 1 and "EvalPython" not in made
    whole = sorted(map(str, got.collect()))
    monkeypatch.setattr(html, "BLOCK_BYTES", 100)
    assert sorted(map(str, documents.extract(d).collect())) == whole and len(whole) == 40
    assert {r.page_id: r.links for r in got.collect()}[6] == ["http://a.example.com/b/6"]


def test_query_traps_hold_no_path_whole(spark):
    from loomdex.streaming import crawl_state

    schema = "path_key string, page_id long, url string, fp_hi long, fp_lo long, pattern string"
    rows = [(f"h/{k % 3}", k, f"u{k}", (k // 18) % 2 * 0xFFFFFFFF, 0, f"^{k % 3}") for k in ((i * 37) % 101 for i in range(101))]
    d = crawl_state.query_traps(spark.createDataFrame(rows, schema))
    made = d._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in made and "MapInArrow" in made
    want, states = [], {}
    for path, page_id, url, hi, lo, pattern in sorted(rows):
        states[path], skip, n, black = crawl_state.step(states.get(path), hi, lo)
        want.append((path, page_id, url, skip, n, pattern if black else None))
    assert sorted(map(str, map(tuple, d.collect()))) == sorted(map(str, want)) and any(w[-1] for w in want)


def test_search_pages_has_an_index_of_asked_terms(spark, folder, monkeypatch):
    from loomdex.operators import index
    from loomdex.plans import catalog

    folder("pages", [(k, f"http://a.example.com/{k}", f"<html><title>cat {k}</title><p>the cats sat on mat{k} {'dog ' * k}</p></html>") for k in range(5)], PAGES)
    folder("benchmark", [(0, "a cat sat"), (1, "the and")], "item_id long, text string")
    made, build = [], index.build
    monkeypatch.setattr(index, "build", lambda *a, **b: made.append(build(*a, **b)) or made[-1])
    got = catalog.search_pages(spark, folder.path).collect()
    assert {r.term for r in made[0].unigrams.collect()} == {"cat", "sat"} and made[0].bigrams.isEmpty()
    from loomdex.operators import documents, search

    full = search.search(build(documents.build(spark.read.parquet(f"{folder.path}/pages.parquet"))), catalog._queries(spark, folder.path))
    assert sorted(map(tuple, got)) == sorted(map(tuple, full.select(*got[0].asDict()).collect()))


def test_stems_that_a_worker_remembers_are_few():
    from loomdex.functions import stemmer

    assert stemmer.stem.cache_info().maxsize <= 1 << 16
