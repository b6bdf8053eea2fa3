"""Crawl analytics: page checks, blacklists, reports, and the frontier as a table."""

from __future__ import annotations

from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.config import DEFAULT, Config
from loomdex.functions import analyzer, footprint, urls
from loomdex.operators.documents import extract
from loomdex.runtime import discard, hadoop_path, ship, stored, trimmed
from loomdex.sources import robots as robots_source
from loomdex.sources.store import fetch

BLACKLIST = "reason string, pattern string"
#: Patterns without a literal host up to which they are part of the plan.
ANYWHERE = 10_000
#: Rows that a Python worker turns into objects at a time.
ROWS = 2_000


def low_value(n_tags: Column, n_tokens: Column, config: Config = DEFAULT) -> Column:
    few = n_tokens < config.low_value_tokens
    return F.when(n_tags > config.low_value_tags, (n_tokens / n_tags < config.low_value_ratio) & few).otherwise(few)


def page_stats(pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(page_id, url, n_tags, n_tokens, sitemap, low_value, links, fp_hi, fp_lo, tokens) of each page that can be read."""
    e = extract(pages).where("error is null")
    text = F.array_join("elems.text", " ")
    e = e.withColumn("tokens", analyzer.crawl_tokens(text)).withColumn("n_tokens", F.size("tokens"))
    e = e.withColumn("fp", footprint.footprint("tokens"))
    return e.select("page_id", "url", "n_tags", "n_tokens", (F.col("n_loc") > 0).alias("sitemap"), low_value(F.col("n_tags"), F.col("n_tokens"), config).alias("low_value"), "links", "fp.fp_hi", "fp.fp_lo", "tokens")


def invalid_response(status: Column, content: Column) -> Column:
    return (status != 200) | content.isNull() | (content == "")


def blacklisted(candidates: DataFrame, blacklist: DataFrame, url_col: str = "url") -> DataFrame:
    """candidates that no pattern matches.

    Patterns that begin with a literal scheme and host, which is what the crawl itself adds, meet the URLs of that host only, in an equi-join.
    Of the others up to ANYWHERE are one alternation each few hundred, compiled once; more are compared pattern by pattern.
    """
    url = F.col(f"`{url_col}`")
    host = F.regexp_replace(F.regexp_extract("pattern", r"^\^([a-z]+://(?:\\.|[^\\.*?/$()\[\]{}|+])+)(?=[/$])", 1), r"\\", "")
    keyed = blacklist.select("pattern", host.alias("_site"))
    own = candidates.withColumn("_site", F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1))
    clean = own.join(keyed.where("_site <> ''"), (own["_site"] == keyed["_site"]) & F.expr(f"`{url_col}` rlike pattern"), "left_anti").drop("_site")
    anywhere = keyed.where("_site = ''").select("pattern").distinct()
    few = [r.pattern for r in anywhere.limit(ANYWHERE + 1).collect()]
    if len(few) > ANYWHERE:
        return clean.join(anywhere, F.expr(f"`{url_col}` rlike pattern"), "left_anti")
    for k in range(0, len(few), 250):
        clean = clean.where(~F.coalesce(url.rlike("|".join(f"(?:{p})" for p in sorted(few)[k : k + 250])), F.lit(False)))
    return clean


def trap_rules(found: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(reason, pattern, temporary) that trapped URLs add; permanent patterns below another one are left out."""
    p = found.where(urls.is_trap(F.col("url"), config)).select(urls.trap_prefix(F.col("url"), config).alias("prefix"), urls.trap_patterns(F.col("url"), config).alias("p")).where("p is not null")
    perm = p.select("prefix", F.col("p.permanent").alias("pattern")).distinct()
    depth = F.size(F.split("prefix", "/", -1))
    above = perm.select(F.explode(F.transform(F.sequence(F.lit(4), F.greatest(depth, F.lit(4))), lambda k: F.struct(F.col("prefix").alias("prefix"), F.array_join(F.slice(F.split("prefix", "/", -1), 1, k), "/").alias("up")))).alias("x")).select("x.*").where("up <> prefix")
    inner = above.join(perm.select(F.col("prefix").alias("up")), "up", "left_semi").select("prefix").distinct()
    permanent = perm.join(inner, "prefix", "left_anti").select(F.lit("repeating path trap").alias("reason"), "pattern", F.lit(False).alias("temporary"))
    temporary = p.select(F.lit("repeating path trap").alias("reason"), F.explode("p.temporary").alias("pattern"), F.lit(True).alias("temporary")).distinct()
    return permanent.unionByName(temporary)


def similar(a: str, b: str, config: Config = DEFAULT) -> Column:
    """Whether structs a and b (url, fp_hi, fp_lo, n_tokens) are pages alike; never for two query pages."""
    c = lambda s, n: F.col(f"{s}.{n}")
    bits = footprint.similarity(c(a, "fp_hi"), c(a, "fp_lo"), c(b, "fp_hi"), c(b, "fp_lo"))
    ratio = footprint.length_ratio(c(a, "n_tokens"), c(b, "n_tokens"))
    return F.coalesce((bits > config.referrer_similarity) & (ratio > config.referrer_similarity) & ~urls.both_queries(c(a, "url"), c(b, "url")), F.lit(False))


def referrer_similarity(stats: DataFrame, referrers: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """stats with like_referrer: alike with the page that linked it, by referrers(url, referrer)."""
    own = ["url", "fp_hi", "fp_lo", "n_tokens"]
    ref = stats.select(F.col("url").alias("referrer"), F.struct(*own).alias("_r"))
    joined = stats.join(referrers, "url", "left").join(ref, "referrer", "left").withColumn("_s", F.struct(*own))
    return joined.withColumn("like_referrer", F.col("_r").isNotNull() & similar("_s", "_r", config)).drop("_r", "_s", "referrer")


def previous_similarity(stats: DataFrame, crawler: str = "1", seq: str = "page_id", config: Config = DEFAULT) -> DataFrame:
    """stats with like_previous: alike with the page crawled before it by the same crawler (an expression)."""
    own = F.struct("url", "fp_hi", "fp_lo", "n_tokens")
    w = Window.partitionBy(F.expr(crawler)).orderBy(seq)
    joined = stats.withColumn("_s", own).withColumn("_r", F.lag("_s").over(w))
    return joined.withColumn("like_previous", F.col("_r").isNotNull() & similar("_s", "_r", config)).drop("_s", "_r")


def token_counts(stats: DataFrame) -> DataFrame:
    return stats.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def top_tokens(stats: DataFrame, k: int = 50) -> DataFrame:
    return token_counts(stats).orderBy(F.desc("n"), "token").limit(k)


def longest_pages(stats: DataFrame, k: int = 10) -> DataFrame:
    return stats.select("url", "n_tokens").orderBy(F.desc("n_tokens"), "url").limit(k)


def subdomains(stats: DataFrame) -> DataFrame:
    return stats.groupBy(urls.part(F.col("url"), "netloc").alias("netloc")).agg(F.count(F.lit(1)).alias("n"))


# frontier(url_hash, url, completed, seq)


def new_urls(frontier: DataFrame, found: DataFrame, seq: int = 0) -> DataFrame:
    """found(url) as frontier rows: slashes stripped, hashed without the scheme, those already there left out."""
    f = found.select(urls.strip_slashes(F.col("url")).alias("url")).withColumn("url_hash", urls.url_hash(F.col("url"))).groupBy("url_hash").agg(F.min("url").alias("url"))
    return f.join(frontier.select("url_hash"), "url_hash", "left_anti").select("url_hash", "url", F.lit(False).alias("completed"), F.lit(seq).cast("long").alias("seq"))


def pop(frontier: DataFrame, n: int, lifo: bool = True) -> DataFrame:
    """The n URLs to crawl next: the newest first, or the oldest."""
    return frontier.where("not completed").orderBy(F.desc("seq") if lifo else F.asc("seq"), "url_hash").limit(n)


def complete(frontier: DataFrame, done: DataFrame) -> DataFrame:
    marks = done.select("url_hash", F.lit(True).alias("_done"))
    return frontier.join(marks, "url_hash", "left").withColumn("completed", F.col("completed") | F.coalesce("_done", F.lit(False))).drop("_done")


def cancel(frontier: DataFrame, patterns: DataFrame) -> DataFrame:
    """The frontier without open URLs that a pattern matches."""
    return frontier.where("completed").unionByName(blacklisted(frontier.where("not completed"), patterns))


def totals(frontier: DataFrame) -> DataFrame:
    return frontier.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("completed")).alias("to_do"))


def resume(frontier: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """What a restart goes on with: open URLs that are valid."""
    return frontier.where(~F.col("completed") & urls.is_valid(F.col("url"), config))


def redirect_rules(responses: DataFrame, blacklist: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(reason, pattern) for failed responses (both URLs) and for redirects to blacklisted or invalid URLs (the source)."""
    bad = responses.where(invalid_response(F.col("status"), F.col("content"))).select(F.explode(F.array("url", "final_url")).alias("u"))
    moved = responses.where((F.col("url") != F.col("final_url")) & ~invalid_response(F.col("status"), F.col("content")))
    fine = blacklisted(moved, blacklist, "final_url").where(urls.is_valid(F.col("final_url"), config)).select("url")
    wrong = moved.join(fine, "url", "left_anti").select(F.col("url").alias("u"))
    return bad.unionByName(wrong).distinct().select(F.lit("bad url").alias("reason"), urls.exact_pattern(F.col("u")).alias("pattern"))


CHECKED = "kind string, host string, url string, reason string, pattern string, path_key string, fp_hi long, fp_lo long, n_tokens long, counter int"
_ASKED = ["host", "seq", "kind", "url", "path_key", "pattern", "fp_hi", "fp_lo", "n_tokens", "counter", "sitemap", "low_value", "ref_url", "ref_hi", "ref_lo", "ref_n"]


def _alike(url: str, mine: tuple, other_url: str, other: tuple, least: float) -> bool:
    """Whether two pages, (hi, lo, tokens) each, are alike; never two query pages."""
    if "?" in url and "?" in other_url:
        return False
    bits = 1 - ((mine[0] ^ other[0]).bit_count() + (mine[1] ^ other[1]).bit_count()) / 64
    longer = max(mine[2], other[2])
    return bits > least and longer > 0 and min(mine[2], other[2]) / longer > least


class HostChecks:
    """The checks of one host's pages, one after the other: query traps, low value, likeness with the referrer and with the page before.

    A sitemap passes without them, and no page is compared with it. The page before is the last one that passed; it isn't compared if it is the referrer.
    """

    def __init__(self, config: Config):
        self.config, self.queries, self.before = config, {}, None

    def page(self, r: dict) -> tuple[str | None, str | None]:
        """(reason to skip the page's links, pattern to blacklist for now)."""
        from loomdex.streaming.crawl_state import step

        if r["sitemap"]:
            self.before = None
            return None, None
        mine, least = (r["fp_hi"], r["fp_lo"], r["n_tokens"]), self.config.referrer_similarity
        if r["path_key"] is not None:
            state, skip, _, black = step(self.queries.get(r["path_key"]), *mine[:2], self.config)
            if state is None:
                self.queries.pop(r["path_key"], None)
            else:
                self.queries[r["path_key"]] = state
            if skip:
                return "query trap", r["pattern"] if black else None
        if r["low_value"]:
            return "low info value", None
        if r["ref_hi"] is not None and _alike(r["url"], mine, r["ref_url"], (r["ref_hi"], r["ref_lo"], r["ref_n"]), least):
            return "like its referrer", None
        if self.before is not None and self.before[0] != r["ref_url"] and _alike(r["url"], mine, *self.before, least):
            return "like the page before", None
        self.before = (r["url"], mine)
        return None, None


def page_checks(stats: DataFrame, referrers: DataFrame, prints: DataFrame, state: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """CHECKED rows: kind `page` for every page of stats(page_id, seq, ...), its reason null if its links count; kinds `query` and `before` are the new state.

    referrers(url, referrer) and prints(url, fp_hi, fp_lo, n_tokens) are of pages that passed earlier, state what the last call gave. A host's
    pages are read as a stream in the order of (seq, url); what is held is the host's state, never its pages.
    """
    ship(stats.sparkSession)
    u = F.col("url")
    head = F.concat(urls.part(u, "scheme"), F.lit("://"), urls.part(u, "netloc"), urls.part(u, "path"))
    query = F.contains(u, F.lit("?"))
    ref = prints.select(F.col("url").alias("ref_url"), F.col("fp_hi").alias("ref_hi"), F.col("fp_lo").alias("ref_lo"), F.col("n_tokens").cast("long").alias("ref_n"))
    known = referrers.groupBy("url").agg(F.min("referrer").alias("ref_url"))
    rows = stats.join(known, "url", "left").join(ref, "ref_url", "left").select(
        urls.part(u, "netloc").alias("host"), F.col("seq").cast("long").alias("seq"), F.lit("page").alias("kind"), "url", F.when(query, F.concat(urls.part(u, "netloc"), urls.part(u, "path"))).alias("path_key"),
        F.concat(F.lit("^"), urls.escape(head), F.lit(".*$")).alias("pattern"), "fp_hi", "fp_lo", F.col("n_tokens").cast("long").alias("n_tokens"), F.lit(None).cast("int").alias("counter"), "sitemap", "low_value", "ref_url", "ref_hi", "ref_lo", "ref_n",
    )
    none = lambda kind: F.lit(None).cast(kind)
    old = state.select("host", F.lit(-1).cast("long").alias("seq"), "kind", "url", "path_key", "pattern", "fp_hi", "fp_lo", "n_tokens", "counter", F.lit(False).alias("sitemap"), F.lit(False).alias("low_value"), none("string").alias("ref_url"), *[none("long").alias(c) for c in ("ref_hi", "ref_lo", "ref_n")])
    names = [x.split()[0] for x in CHECKED.split(", ")]

    def each(batches):
        host, now, out = None, HostChecks(config), []

        def close() -> None:
            for key, (hi, lo, n) in now.queries.items():
                out.append(dict.fromkeys(names) | {"kind": "query", "host": host, "path_key": key, "fp_hi": hi, "fp_lo": lo, "counter": n})
            if now.before:
                out.append(dict.fromkeys(names) | {"kind": "before", "host": host, "url": now.before[0], "fp_hi": now.before[1][0], "fp_lo": now.before[1][1], "n_tokens": now.before[1][2]})

        def batch() -> pa.RecordBatch:
            kinds = {"counter": pa.int32()} | dict.fromkeys(("fp_hi", "fp_lo", "n_tokens"), pa.int64())
            made = pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds.get(c, pa.string())) for c in names], names=names)
            out.clear()
            return made

        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            for r in b.to_pylist():
                if r["host"] != host:
                    close()
                    host, now = r["host"], HostChecks(config)
                if r["kind"] == "query":
                    now.queries[r["path_key"]] = (r["fp_hi"], r["fp_lo"], r["counter"])
                elif r["kind"] == "before":
                    now.before = (r["url"], (r["fp_hi"], r["fp_lo"], r["n_tokens"]))
                else:
                    reason, pattern = now.page(r)
                    out.append({c: r.get(c) for c in names} | {"reason": reason, "pattern": pattern, "counter": None})
            yield batch()
        close()
        if out:
            yield batch()

    return rows.select(*_ASKED).unionByName(old.select(*_ASKED)).repartition("host").sortWithinPartitions("host", "seq", "url").mapInArrow(trimmed(each), CHECKED)


def expand(stats: DataFrame, blacklist: DataFrame, ruled: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """(src_url, url): the links worth crawling: parameters sorted, valid, not blacklisted, no trap, and allowed by robots rules."""
    links = stats.where(F.col("sitemap") | ~F.col("low_value")).select(F.col("url").alias("src_url"), F.explode("links").alias("raw")).select("src_url", urls.sort_query(F.col("raw")).alias("url")).distinct()
    return worth_crawling(links, blacklist, ruled, config)


def worth_crawling(links: DataFrame, blacklist: DataFrame, ruled: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """The links(..., url) that pass all URL checks."""
    good = blacklisted(links.where(urls.is_valid(F.col("url"), config) & ~urls.is_trap(F.col("url"), config)), blacklist)
    return good if ruled is None else robots_source.can_fetch(good, ruled).where("allowed").drop("allowed")


def sitemap_urls(hosts: DataFrame, ruled: DataFrame, pages: DataFrame, blacklist: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(url) that the robots files of hosts(host) name: the lines of text sitemaps in the page store, other sitemaps themselves if they pass the checks."""
    maps = ruled.join(hosts, ruled.netloc == hosts.host, "left_semi").select(F.explode("sitemaps").alias("url")).distinct()
    text = F.lower("url").endswith(".txt")
    lines = fetch(maps.where(text), pages).where(~invalid_response(F.col("status"), F.col("content")) & urls.is_valid(F.col("final_url"), config))
    listed = lines.select(F.explode(F.split("content", "\r?\n")).alias("url")).select(F.trim("url").alias("url")).where("url <> ''")
    return listed.unionByName(worth_crawling(maps.where(~text), blacklist, None, config)).distinct()


_TABLES = ("frontier", "blacklist", "referrers", "prints", "state", "stats")


def _save(tables: dict[str, DataFrame], path: str, k: int) -> None:
    for name in _TABLES:
        if tables[name] is not None:
            tables[name].write.mode("overwrite").parquet(f"{path}/round={k:09d}/{name}")
    fs, done = hadoop_path(tables["frontier"].sparkSession, f"{path}/round={k:09d}/_DONE")
    fs.create(done, True).close()


def _load(spark, path: str) -> tuple[int, dict[str, DataFrame]]:
    """(round, tables) of the last round that was saved whole; (0, nothing) without one."""
    fs, top = hadoop_path(spark, path)
    found = sorted(s.getPath().getName() for s in fs.listStatus(top)) if fs.exists(top) else []
    whole = [n for n in found if n.startswith("round=") and fs.exists(hadoop_path(spark, f"{path}/{n}/_DONE")[1])]
    if not whole:
        return 0, {}
    here = lambda n: f"{path}/{whole[-1]}/{n}"
    return int(whole[-1][6:]), {n: spark.read.parquet(here(n)) for n in _TABLES if fs.exists(hadoop_path(spark, here(n))[1])}


def crawl(pages: DataFrame, seeds: DataFrame, rounds: int | None, batch: int | None, lifo: bool = True, robots: DataFrame | None = None, config: Config = DEFAULT, checkpoint: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frontier, page stats, blacklist) after so many rounds over a page store, or (None) when no URL is open.

    A round pops a batch (None: all open URLs), fetches, checks, and pushes what is new. Links count only of pages that pass page_checks(): no
    query trap, of some value, unlike the page that linked them and unlike the page before on their host. Sitemaps in the robots files of
    hosts that are met for the first time are followed. Each of a round's tables is written to the shared folder, so a lost executor repeats no
    earlier round. checkpoint: a path where each round's frontier, blacklist, referrers, footprints and trap state are kept; a crawl that
    finds some there goes on with them, without the URLs that are no longer valid. The rate of a live crawl is batch over the time between rounds.
    """
    spark = pages.sparkSession
    ruled = None if robots is None else stored(robots_source.rules(robots), "robots")
    none = lambda schema: spark.createDataFrame([], schema)
    start, t = _load(spark, checkpoint) if checkpoint else (0, {})
    if t:
        frontier = stored(t["frontier"].where("completed").unionByName(resume(t["frontier"], config)), "frontier")
    else:
        frontier = stored(new_urls(none("url_hash string"), seeds), "frontier")
    blacklist, referrers = t.get("blacklist", none(BLACKLIST)), t.get("referrers", none("url string, referrer string"))
    prints, state, seen = t.get("prints", none("url string, fp_hi long, fp_lo long, n_tokens int")), t.get("state", none(CHECKED)), t.get("stats")
    for k in count(start + 1) if rounds is None else range(start + 1, start + rounds + 1):
        now = stored(frontier.where("not completed") if batch is None else pop(frontier, batch, lifo), "batch")
        if now.isEmpty():
            break
        got = stored(fetch(now.select("url"), pages), "fetched")
        fine = got.where(~invalid_response(F.col("status"), F.col("content"))).select(F.xxhash64("url").alias("page_id"), "url", F.col("content").alias("html"))
        stats = stored(page_stats(fine, config), "stats")
        checked = stored(page_checks(stats.withColumn("seq", F.lit(k)), referrers, prints, state, config), "checked")
        new_state = checked.where("kind <> 'page'")
        passed = stats.join(checked.where("kind = 'page' and reason is null").select("url"), "url", "left_semi")
        low = checked.where("reason = 'low info value'").select("reason", urls.exact_pattern(F.col("url")).alias("pattern"))
        links = passed.select(F.explode("links").alias("url")).where(urls.is_valid(F.col("url"), config))
        traps = trap_rules(links, config).unionByName(checked.where("kind = 'page' and pattern is not null").select(F.lit("query trap").alias("reason"), "pattern", F.lit(True).alias("temporary")).distinct())
        traps = stored(traps, "traps")
        blacklist = stored(blacklist.unionByName(redirect_rules(got, blacklist, config)).unionByName(low).unionByName(traps.where("not temporary").select("reason", "pattern")).distinct(), "blacklist")
        barred = blacklist.unionByName(traps.select("reason", "pattern"))
        more = stored(expand(passed.withColumn("low_value", F.lit(False)), barred, ruled, config).select("url", F.col("src_url").alias("referrer")), "links")
        found = more.select("url")
        if ruled is not None:
            host = lambda df: df.select(urls.part(F.col("url"), "netloc").alias("host")).distinct()
            found = found.unionByName(sitemap_urls(host(now).join(host(frontier.where("completed")), "host", "left_anti"), ruled, pages, barred, config))
        fresh = stored(new_urls(frontier, found, k), "fresh")
        linked = more.withColumn("url", urls.strip_slashes(F.col("url"))).join(fresh.select("url"), "url", "left_semi").groupBy("url").agg(F.min("referrer").alias("referrer"))
        old = frontier, prints, referrers, state
        referrers = stored(referrers.unionByName(linked), "referrers")
        prints = stored(prints.unionByName(passed.where("not sitemap").select("url", "fp_hi", "fp_lo", F.col("n_tokens").cast("int"))), "prints")
        frontier = stored(cancel(complete(frontier, now), traps.select("pattern")).unionByName(fresh), "frontier")
        state = stored(new_state.unionByName(state.join(new_state.select("host").distinct(), "host", "left_anti")), "state")
        seen = stats if seen is None else seen.unionByName(stats)
        discard(*old, now, got, checked, more, fresh)
        if checkpoint:
            _save({"frontier": frontier, "blacklist": blacklist, "referrers": referrers, "prints": prints, "state": state, "stats": seen}, checkpoint, k)
    return frontier, seen if seen is not None else page_stats(pages.limit(0), config), blacklist


def report(stats: DataFrame) -> dict[str, DataFrame]:
    """The crawl's report: unique URLs, longest pages, top tokens, pages per subdomain."""
    return {"unique": stats.agg(F.countDistinct("url").alias("n")), "longest": longest_pages(stats), "tokens": top_tokens(stats), "subdomains": subdomains(stats).orderBy("netloc")}
