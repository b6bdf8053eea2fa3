"""URL filters: rules, and link-graph propagation of trust and distrust over host edges."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import pick, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to which their table is sent to every executor.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.call_function("instr", url, F.lit("://")), F.lit(0))
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts in pages' href attributes; links without a host stay on their own."""
    found = F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    rows = pick(pages, url=url_col, html=html_col).select(host_of(F.col("url")).alias("src"), F.explode(found).alias("link"))
    link = F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), F.col("link"))).otherwise(F.col("link"))
    return rows.select("src", host_of(link).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = 20, tolerance: float = 1e-6) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank: trust follows links from seeds(host, good, bad)'s good, distrust goes back along links from bad.

    good and bad are seed weights, normalised here; a host's mass is dealt to its links by their numbers, and mass of hosts without links returns to the
    seeds. Each round is two joins with the stored edges and one pre-aggregated sum, written to the shared folder; it ends after `rounds` (None: no
    bound) or when less than `tolerance` moves and no host was reached for the first time. Without links the seeds' weights are the result.
    """
    edges = stored(links.join(links.groupBy("src").agg(F.sum("n").alias("out")), "src").join(links.groupBy("dst").agg(F.sum("n").alias("into")), "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("forth"), (F.col("n") / F.col("into")).alias("back")), "edges")
    hosts = seeds.select("host", "good", "bad").unionByName(edges.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0).alias("good"), F.lit(0.0).alias("bad"))).groupBy("host").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    hosts = stored(hosts, "hosts")
    g, b = (max(x or 0.0, 0.0) for x in hosts.agg(F.sum("good"), F.sum("bad")).first())
    part = lambda c, total: F.col(c) / total if total else F.lit(0.0)
    now = stored(hosts.select("host", part("good", g).alias("g0"), part("bad", b).alias("b0")).withColumns({"trust": F.col("g0"), "distrust": F.col("b0")}), "rank")
    if edges.isEmpty():
        return now.select("host", "trust", "distrust")
    for _ in count() if rounds is None else range(rounds):
        side = now.select("host", "trust", "distrust")
        forth = edges.join(side, edges.src == side.host).select(F.col("dst").alias("host"), (F.col("trust") * F.col("forth")).alias("t"), F.lit(0.0).alias("d"))
        back = edges.join(side, edges.dst == side.host).select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("back")).alias("d"))
        came = stored(forth.unionByName(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "came")
        t, d = (x or 0.0 for x in came.agg(F.sum("t"), F.sum("d")).first())
        mass = lambda c, seed, lost: F.lit(1 - damping) * F.col(seed) + F.lit(damping) * (F.coalesce(c, F.lit(0.0)) + F.lit(lost) * F.col(seed))
        new = now.join(came, "host", "left").select("host", "g0", "b0", mass(F.col("t"), "g0", 1 - t if g else 0.0).alias("trust"), mass(F.col("d"), "b0", 1 - d if b else 0.0).alias("distrust"), F.col("trust").alias("trust_was"), F.col("distrust").alias("distrust_was"))
        new = stored(new, "rank")
        first = lambda c: (F.col(f"{c}_was") == 0) & (F.col(c) > 0)
        moved, reached = new.agg(F.sum(F.abs(F.col("trust") - F.col("trust_was")) + F.abs(F.col("distrust") - F.col("distrust_was"))), F.count_if(first("trust") | first("distrust"))).first()
        now = new.drop("trust_was", "distrust_was")
        if moved < tolerance and not reached:
            break
    return now.select("host", "trust", "distrust")


def matching(hosts: DataFrame, rules: list[Rule] | tuple[Rule, ...]) -> DataFrame:
    """(host, rules): for each host the rules of its own name and of all names above it; hosts without any are left out."""
    spark = hosts.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "of string, path string, rule string, verdict string")
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    labels = F.split("host", r"\.", -1)
    names = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("of"))
    return names.join(table, "of").groupBy("host").agg(F.collect_set(F.struct(F.length("rule").alias("long"), "rule", "path", "verdict")).alias("rules"))


def judge(pages: DataFrame, rules: list[Rule] | tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = 0.5, **kw) -> DataFrame:
    """A row per page: page_id, host, path, rule (the longest that fits, of equally long ones the last by name; else null), verdict, trust, distrust.

    A rule fits its host and all names below it, if the path starts with the rule's. Hosts most of whose pages a rule blocks are blocked seeds; hosts with
    more pages allowed than blocked by rules are trusted seeds. A page without a rule gets its host's verdict: block if distrust is over zero and
    at least the share `least` of trust and distrust together, which propagate() spreads over the links between hosts, else allow: scores
    are spread until they settle, and no absolute bound on them counts, as they shrink with the number of seeds. A null
    url, or one without ://, has host and path empty and is allowed. Repeated rows are judged each. Pages are joined with hosts as stored
    tables, so that AQE can split a host with a third of the pages.
    """
    rows = stored(pick(pages, page_id=id_col, url=url_col).select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path")), "pages")
    names = stored(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "names")
    near = stored(matching(names, rules), "rules")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["long"].alias("long"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    ruled = stored(rows.join(near, "host", "left").select("page_id", "host", "path", best.alias("best")).select("page_id", "host", "path", "best.rule", F.col("best.verdict").alias("said")), "ruled")
    seen = ruled.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("said") == "block").alias("bad"), F.count_if(F.col("said") == "allow").alias("good"))
    seeds = seen.where("host <> ''").select("host", F.when(F.col("good") > F.col("bad"), 1.0).otherwise(0.0).alias("good"), F.when(2 * F.col("bad") > F.col("n"), 1.0).otherwise(0.0).alias("bad"))
    scores = stored(propagate(host_links(pages, url_col, html_col), stored(seeds, "seeds"), **{"rounds": None, **kw}), "scores")
    score = ruled.join(scores, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    own = F.when((F.col("distrust") > 0) & (F.col("distrust") >= least * (F.col("trust") + F.col("distrust"))), F.lit("block")).otherwise(F.lit("allow"))
    return score.select("page_id", "host", "path", "rule", F.coalesce("said", own).alias("verdict"), "trust", "distrust")


