"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import distinct_name, pick, size_of, stored

#: A line goes if more than this share of its site's pages have it, and at least so many pages.
MAX_SHARE = 0.05
MIN_PAGES = 5
#: Rows of boilerplate lines up to which they are sent to every executor (24 bytes and the host's name each).
BROADCAST_ROWS = 50_000
SALT = 64


def _lines(text):
    return F.split(text, "\n", -1)


def _clean(line):
    return F.trim(line)


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, h1, h2, pages, total): lines, as two 64-bit hashes of their trimmed text, that exceed the ratio on their host.

    A page counts once for a line however often it has it. Blank lines are never boilerplate. Rows without a host belong to no site; null
    texts count as pages without lines. Counts are pre-aggregated before each shuffle, so a host with most of the rows costs no more.
    """
    rows = pick(docs, host=host_col, body=text_col).where("host is not null")
    total = rows.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    keys = F.array_distinct(F.transform(F.filter(F.transform(_lines(F.col("body")), _clean), lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"))))
    pages = rows.where("body is not null").select("host", F.inline(keys)).groupBy("host", "h1", "h2").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    return pages.join(total, "host").where(F.col("pages") > F.col("total") * F.lit(float(max_share)))


def drop_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES, n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """docs with every boilerplate line removed from text_col; all other lines stay as they are, in order. Rows and columns stay.

    n_lines, n_dropped: names of count columns to add. A null text stays null (0 lines); the empty text has one blank line. The host's few
    boilerplate lines are joined to its pages as an array: sent to all executors if the whole table has at most BROADCAST_ROWS rows, else
    by a shuffle in which every host is split over SALT keys by a hash of the row, so that a host with a third of the pages is no task of its own.
    """
    found = stored(boilerplate(docs, host_col, text_col, max_share, min_pages), "boilerplate")
    packed = found.groupBy("host").agg(F.collect_set(F.struct("h1", "h2")).alias("keys"))
    host, keys, salt, kept = (distinct_name(docs, c) for c in ("_site", "_keys", "_salt", "_lines"))
    packed = packed.select(F.col("host").alias(host), F.col("keys").alias(keys))
    if size_of(found)[0] <= BROADCAST_ROWS:
        joined = docs.join(F.broadcast(packed), docs[f"`{host_col}`"] == packed[host], "left")
    else:
        split = packed.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        # by the whole row, so that copies of one text are spread too; maps can't be hashed
        spread = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString()]
        side = docs.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(SALT)).cast("int"))
        joined = side.join(split, (side[f"`{host_col}`"] == split[host]) & (side[salt] == split[salt]), "left").drop(split[salt])
    body = F.col(f"`{text_col}`")
    bad = lambda x: F.array_contains(F.col(keys), F.struct(F.xxhash64(_clean(x)).alias("h1"), F.xxhash64(F.lit(1), _clean(x)).alias("h2")))
    joined = joined.withColumn(kept, F.when(F.col(keys).isNull(), _lines(body)).otherwise(F.filter(_lines(body), lambda x: (_clean(x) == "") | ~bad(x))))
    extra = []
    if n_lines:
        extra.append(F.when(body.isNull(), 0).otherwise(F.size(_lines(body))).cast("long").alias(n_lines))
    if n_dropped:
        extra.append(F.when(body.isNull(), 0).otherwise(F.size(_lines(body)) - F.size(kept)).cast("long").alias(n_dropped))
    own = [F.when(F.col(keys).isNull(), body).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*own, *extra)


def sql(max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES) -> str:
    """DuckDB: doc_id, n_lines, n_dropped, text of documents."""
    return f"""
with l as (select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents where text is not null),
 totals as (select source, count(*) as total from documents where source is not null group by source),
 pages as (select source, trim(line, ' ') as t, count(distinct doc_id) as pages from l where trim(line, ' ') <> '' group by 1, 2),
 bad as (select p.source, p.t from pages p join totals h on p.source = h.source where p.pages >= {min_pages} and p.pages > h.total * cast({max_share} as double)),
 marked as (select l.doc_id, l.k, l.line, b.t is not null as gone from l left join bad b on l.source = b.source and trim(l.line, ' ') = b.t)
select d.doc_id, coalesce(m.n_lines, 0) as n_lines, coalesce(m.n_dropped, 0) as n_dropped, case when d.text is null then null else coalesce(m.body, '') end as text
from documents d left join (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, string_agg(line, chr(10) order by k) filter (not gone) as body from marked group by doc_id) m on d.doc_id = m.doc_id
"""
