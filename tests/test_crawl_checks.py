"""A crawl with page checks, sitemaps and resumption, against a sequential version."""

import random

import pytest

from loomdex.config import DEFAULT
from loomdex.operators import crawl
from loomdex.streaming.crawl_state import step

PAGES = "page_id long, url string, html string"
LINK = "url string"


def html(words, *to):
    return "<html>" + "".join(f"<a href='{x}'>w</a>" for x in to) + f"<p>{words}</p></html>"


def words(rng, n=200):
    return " ".join(f"w{''.join(rng.choice('abcdefgh') for _ in range(6))}" for _ in range(n))


def site():
    """A site with alike pages, pages of no value, and a calendar of alike query pages."""
    rng = random.Random(4)
    same, pages = words(rng), []
    add = lambda path, text, *to: pages.append((len(pages), f"http://example.com/{path}", html(text, *to)))
    add("a", words(rng), "/b", "/c", "/poor", *[f"/cal?d={k}" for k in range(6)])
    add("b", same, "/b2", "/d")
    add("b2", same, "/hidden1")  # like its referrer
    add("c", words(rng), "/e")
    add("d", words(rng))
    add("e", words(rng))
    add("poor", "few words", "/hidden2")
    for k in range(6):
        add(f"cal?d={k}", same + f" day{k}", f"/hidden3-{k}")
    for x in ("hidden1", "hidden2", *[f"hidden3-{k}" for k in range(6)]):
        add(x, words(rng))
    return pages


def test_links_of_checked_pages_only(spark):
    pages = spark.createDataFrame(site(), PAGES)
    frontier, _, black = crawl.crawl(pages, spark.createDataFrame([("http://example.com/a",)], LINK), None, None)
    got = {r.url.rsplit("/", 1)[1] for r in frontier.collect()}
    assert {"a", "b", "b2", "c", "d", "e", "poor"} <= got
    assert "hidden1" not in got and "hidden2" not in got
    # of the six calendar pages three are alike with the first, then the path is barred and its count begins anew
    assert sum(x.startswith("hidden3") for x in got) == 2
    assert "low info value" in {r.reason for r in black.collect()}


def sequential(rows, config=DEFAULT):
    """The checks one page after the other."""
    queries, before, out = {}, {}, []

    def alike(u, m, v, o):
        if "?" in u and "?" in v:
            return False
        same = 1 - (bin(m[0] ^ o[0]).count("1") + bin(m[1] ^ o[1]).count("1")) / 64
        return same > config.referrer_similarity and min(m[2], o[2]) / max(m[2], o[2]) > config.referrer_similarity

    for r in sorted(rows, key=lambda r: (r["host"], r["seq"], r["url"])):
        h, m = r["host"], (r["fp_hi"], r["fp_lo"], r["n_tokens"])
        if r["sitemap"]:
            before[h], why = None, None
        else:
            why = None
            if "?" in r["url"]:
                key = r["url"].split("://")[1].split("?")[0]
                state, skip, _, _ = step(queries.get(key), *m[:2], config)
                queries.pop(key, None)
                if state is not None:
                    queries[key] = state
                why = "query trap" if skip else None
            if why is None and r["low_value"]:
                why = "low info value"
            if why is None and r["ref"] and alike(r["url"], m, *r["ref"]):
                why = "like its referrer"
            if why is None and before.get(h) and before[h][0] != (r["ref"] or [None])[0] and alike(r["url"], m, *before[h]):
                why = "like the page before"
            if why is None:
                before[h] = (r["url"], m)
        out.append((r["url"], why))
    return dict(out)


@pytest.mark.parametrize("parts", [1, 3])
def test_checks_equal_sequential(spark, parts):
    rng = random.Random(7)
    prints = [(f"http://r{k}.com/", rng.choice([0, 1, 255, (1 << 32) - 1]), 0, rng.choice([100, 101, 300])) for k in range(6)]
    rows, refs = [], []
    for k in range(160):
        host = f"h{k % 3}.com"
        url = f"http://{host}/{rng.choice('pq')}?x={k}" if rng.random() < 0.4 else f"http://{host}/{k}"
        ref = rng.choice([None, None, *prints])
        rows.append({"url": url, "host": host, "seq": k * parts // 160, "fp_hi": rng.choice([0, 1, 255, (1 << 32) - 1]), "fp_lo": 0, "n_tokens": rng.choice([100, 101, 300]), "sitemap": rng.random() < 0.05, "low_value": rng.random() < 0.1, "ref": (ref[0], ref[1:]) if ref else None})
        if ref:
            refs.append((url, ref[0]))
    empty = lambda s: spark.createDataFrame([], s)
    state, got = empty(crawl.CHECKED), {}
    p = spark.createDataFrame(prints, "url string, fp_hi long, fp_lo long, n_tokens int")
    for k in range(parts):  # a call for each round, with the state of the one before
        some = spark.createDataFrame([(r["url"], r["seq"], r["fp_hi"], r["fp_lo"], r["n_tokens"], r["sitemap"], r["low_value"]) for r in rows if r["seq"] == k], "url string, seq long, fp_hi long, fp_lo long, n_tokens int, sitemap boolean, low_value boolean")
        out = crawl.page_checks(some, spark.createDataFrame(refs, "url string, referrer string"), p, state).collect()
        got |= {r.url: r.reason for r in out if r.kind == "page"}
        state = spark.createDataFrame([r for r in out if r.kind != "page"], crawl.CHECKED)
    assert got == sequential(rows)


def test_sitemaps_and_resumption(spark, tmp_path):
    rng = random.Random(1)
    pages = spark.createDataFrame([
        (1, "http://example.com/a", html(words(rng), "/b")), (2, "http://example.com/b", html(words(rng), "/c")), (3, "http://example.com/c", html(words(rng))),
        (4, "http://example.com/map.txt", "http://example.com/x\nhttp://example.com/y\r\n"), (5, "http://example.com/x", html(words(rng))),
        (6, "http://example.com/map.xml", "<urlset><url><loc>http://example.com/z</loc></url></urlset>"), (7, "http://example.com/z", html(words(rng))),
    ], PAGES)
    robots = spark.createDataFrame([("example.com", 200, "User-agent: *\nDisallow: /none\nSitemap: http://example.com/map.txt\nSitemap: http://example.com/map.xml\n")], "netloc string, status int, body string")
    seeds = spark.createDataFrame([("http://example.com/a",)], LINK)
    whole = crawl.crawl(pages, seeds, None, None, robots=robots)[0]
    want = {(r.url, r.completed) for r in whole.collect()}
    assert {u.rsplit("/", 1)[1] for u, _ in want} == {"a", "b", "c", "x", "y", "z", "map.xml"} and all(done for _, done in want)
    path = f"file://{tmp_path}/state"
    crawl.crawl(pages, seeds, 1, None, robots=robots, checkpoint=path)
    again, seen, _ = crawl.crawl(pages, spark.createDataFrame([], LINK), None, None, robots=robots, checkpoint=path)
    assert {(r.url, r.completed) for r in again.collect()} == want
    assert "http://example.com/a" in {r.url for r in seen.collect()}
