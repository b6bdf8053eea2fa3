"""robots.txt bodies to rule tables, and who may fetch what."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions import urls
from loomdex.runtime import arrow_udf, ship

ROBOTS = "entries array<struct<agents array<string>, rules array<struct<pattern string, allow boolean>>, delay int, requests int, seconds int>>, sitemaps array<string>"


def rule_pattern(path: str) -> str:
    """A regex for a rule's path: * is anything, a final $ the end; without it the rest is open."""
    end = path.endswith("$")
    body = ".*".join(re.escape(p) for p in (path[:-1] if end else path).split("*"))
    return f"^{body}{'$' if end else ''}"


def parse(body: str) -> dict:
    """Groups of user-agent lines and the rules below them; a blank line or a user-agent after rules ends a group."""
    groups: list[dict] = []
    sitemaps: list[str] = []
    now: dict | None = None
    for raw in body.splitlines():
        line = raw.split("#", 1)[0].strip()
        if not line:
            if now and not raw.strip() and (now["rules"] or now["delay"] is not None or now["requests"]):
                now = None
            continue
        name, colon, value = line.partition(":")
        if not colon:
            continue
        name, value = name.strip().lower(), value.strip()
        if name == "user-agent":
            if now is None or now["closed"]:
                now = {"agents": [], "rules": [], "delay": None, "requests": None, "seconds": None, "closed": False}
                groups.append(now)
            now["agents"].append(value)
        elif name == "sitemap":
            sitemaps.append(value)
        elif now is not None:
            now["closed"] = True
            if name in ("allow", "disallow"):
                allow = name == "allow" or not value  # an empty Disallow allows all
                now["rules"].append({"pattern": rule_pattern(value), "allow": allow})
            elif name == "crawl-delay" and value.isdigit():
                now["delay"] = int(value)
            elif name == "request-rate" and re.fullmatch(r"\d+\s*/\s*\d+", value):
                now["requests"], now["seconds"] = map(int, value.split("/"))
    return {"entries": [{k: v for k, v in g.items() if k != "closed"} for g in groups], "sitemaps": sitemaps}


@arrow_udf(ROBOTS)
def _parse(body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(b or "") for b in body], columns=["entries", "sitemaps"])


def rules(robots: DataFrame) -> DataFrame:
    """robots(netloc, status, body) -> (netloc, policy, entries, sitemaps): 401 and 403 forbid all, other 4xx and missing bodies allow all."""
    ship(robots.sparkSession)
    policy = F.when(F.col("status").isin(401, 403), F.lit("none")).when(F.col("status").between(400, 499) | F.col("body").isNull(), F.lit("all")).otherwise(F.lit("rules"))
    return robots.withColumn("r", _parse("body")).select("netloc", policy.alias("policy"), "r.entries", "r.sitemaps")


def applies(agents: Column, agent: str) -> Column:
    """An entry's agent is *, or part of ours before the slash, in any case."""
    own = agent.split("/")[0].lower()
    return F.exists(agents, lambda a: (a == "*") | F.contains(F.lit(own), F.lower(a)))


def can_fetch(pages: DataFrame, ruled: DataFrame, agent: str = "*", url_col: str = "url") -> DataFrame:
    """pages with allowed (boolean): the first entry for the agent, else the * entry, decides; any matching Allow wins; no rules, no bar."""
    host, path = urls.part(F.col(url_col), "netloc"), F.concat(urls.part(F.col(url_col), "path"), F.when(F.contains(F.col(url_col), F.lit("?")), F.concat(F.lit("?"), urls.part(F.col(url_col), "query"))).otherwise(""))
    own = F.filter("entries", lambda e: applies(e["agents"], agent) & ~F.array_contains(e["agents"], "*"))
    star = F.filter("entries", lambda e: F.array_contains(e["agents"], "*"))
    entry = F.coalesce(F.get(own, 0), F.get(star, 0))
    joined = pages.withColumn("_host", host).join(ruled.select(F.col("netloc").alias("_host"), "policy", entry.alias("_entry")), "_host", "left").withColumn("_path", F.when(path == "", "/").otherwise(path))
    hit = F.filter(F.col("_entry.rules"), lambda r: F.call_function("rlike", F.col("_path"), r["pattern"]))
    allowed = F.when(F.col("policy") == "none", False).when(F.col("policy").isNull() | (F.col("policy") == "all") | F.col("_entry").isNull(), True).otherwise(F.exists(hit, lambda r: r["allow"]) | (F.size(hit) == 0))
    return joined.withColumn("allowed", allowed).drop("_host", "_path", "_entry", "policy")


def access(ruled: DataFrame, agent: str = "*") -> DataFrame:
    """(netloc, delay, requests, seconds, sitemaps) for the agent."""
    entry = F.get(F.filter("entries", lambda e: applies(e["agents"], agent)), 0)
    return ruled.select("netloc", entry["delay"].alias("delay"), entry["requests"].alias("requests"), entry["seconds"].alias("seconds"), "sitemaps")
