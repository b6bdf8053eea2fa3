"""URL functions as columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.config import BAD_EXTENSIONS, DEFAULT, Config
from loomdex.runtime import arrow_udf

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, name: str) -> Column:
    """scheme, netloc, path, query or fragment; empty where missing."""
    return F.regexp_extract(url, f"(?s){_PARTS}", ["scheme", "netloc", "path", "query", "fragment"].index(name) + 1)


def defrag(url: Column) -> Column:
    return F.regexp_replace(url, "(?s)#.*$", "")


def strip_slashes(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def sort_query(url: Column) -> Column:
    """Two or more & parameters sorted; anything else stays."""
    query = part(url, "query")
    ordered = F.array_join(F.array_sort(F.split(query, "&")), "&")
    rebuilt = F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.lit("?"), ordered, F.regexp_extract(url, r"(?s)(#.*)$", 1))
    return F.when(F.contains(query, F.lit("&")), rebuilt).otherwise(url)


def url_hash(url: Column) -> Column:
    """sha256 of everything but the scheme."""
    path = part(url, "path")
    return F.sha2(F.concat_ws("/", part(url, "netloc"), F.regexp_extract(path, r"^([^;]*)", 1), F.regexp_extract(path, r"^[^;]*;?(.*)$", 1), part(url, "query"), part(url, "fragment")), 256)


def bad_extension(url: Column) -> Column:
    return F.lower(part(url, "path")).rlike(rf"\.({'|'.join(BAD_EXTENSIONS)})$")


def is_valid(url: Column, config: Config = DEFAULT) -> Column:
    """http or https, an allowed domain or a name below it, and no extension that isn't crawled."""
    hosts = "|".join(d.replace(".", r"\.") for d in config.allowed_domains)
    return F.coalesce(F.lower(part(url, "scheme")).isin("http", "https") & F.lower(part(url, "netloc")).rlike(rf"^([-a-z0-9]+\.)*({hosts})$") & ~bad_extension(url), F.lit(False))


def path_repeats(url: Column, config: Config = DEFAULT) -> Column:
    """Lower-cased path segments that occur more than path_repeats times, sorted."""
    segments = F.split(F.lower(part(url, "path")), "/")
    return F.array_sort(F.filter(F.array_distinct(segments), lambda s: F.size(F.filter(segments, lambda x: x == s)) > config.path_repeats))


def is_trap(url: Column, config: Config = DEFAULT) -> Column:
    return F.size(path_repeats(url, config)) > 0


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.^$|?*+()\[\]{}\-&~# ])", r"\\$1")


def exact_pattern(url: Column) -> Column:
    """A regex for this URL, a trailing slash being optional."""
    return F.concat(F.lit("^"), escape(F.regexp_replace(url, "/$", "")), F.when(url.endswith("/"), F.lit("/?$")).otherwise(F.lit("$")))


def trap_prefix(url: Column, config: Config = DEFAULT) -> Column:
    """The URL before the first segment that repeats; null if none does."""
    segments = F.split(F.lower(part(url, "path")), "/")
    bad = path_repeats(url, config)
    first = F.array_min(F.filter(F.transform(segments, lambda s, i: F.when(F.array_contains(bad, s) & (s != ""), i)), lambda i: i.isNotNull()))
    head = F.regexp_extract(url, r"^((?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)", 1)
    return F.when(first.isNotNull(), F.concat(head, F.array_join(F.slice(F.split(part(url, "path"), "/"), 1, first), "/")))


def trap_patterns(url: Column, config: Config = DEFAULT) -> Column:
    """struct(permanent, temporary[]): the prefix and all below it; and, above the prefix's last segment, each repeating segment anywhere."""
    prefix = trap_prefix(url, config)
    above = escape(F.regexp_replace(prefix, "/[^/]*$", ""))
    temporary = F.transform(F.filter(path_repeats(url, config), lambda s: s != ""), lambda s: F.concat(F.lit("^"), above, F.lit("/.*"), escape(s), F.lit(".*$")))
    return F.when(prefix.isNotNull(), F.struct(F.concat(F.lit("^"), escape(prefix), F.lit(".*$")).alias("permanent"), temporary.alias("temporary")))


def last_segment(url: Column) -> Column:
    return F.trim(F.regexp_extract(part(url, "path"), r"([^/]*)$", 1))


def both_queries(a: Column, b: Column) -> Column:
    return F.contains(a, F.lit("?")) & F.contains(b, F.lit("?"))


def joined(base: str | None, links) -> list[str]:
    """A page's links joined with its URL, without fragments, distinct and sorted."""
    from urllib.parse import urldefrag, urljoin

    out = set()
    for x in () if links is None or base is None else links:
        try:
            out.add(urldefrag(urljoin(base, x))[0])
        except ValueError:  # not a URL: skipped like any page error
            continue
    return sorted(out)


@arrow_udf("array<string>")
def resolve(base: pd.Series, links: pd.Series) -> pd.Series:
    """Links joined with the page's URL, without fragments, distinct and sorted."""
    return pd.Series([joined(b, xs) for b, xs in zip(base, links, strict=True)])
