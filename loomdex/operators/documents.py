"""Pages to documents: extraction, tokens, extents, first-wins and near-duplicate dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.config import DEFAULT, Config
from loomdex.functions import analyzer, footprint, urls
from loomdex.runtime import ship, stored
from loomdex.sources.html import pages as parsed


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url (without fragment), title, elems, links (absolute), n_tags, n_loc, is_html, error."""
    ship(pages.sparkSession)
    url = urls.defrag(F.col("url"))
    return parsed(pages.select("page_id", url.alias("url"), F.coalesce("html", F.lit("")).alias("html")))


def errors(extracted: DataFrame) -> DataFrame:
    """Pages that couldn't be read: the run's log."""
    return extracted.where("error is not null").select("page_id", "url", "error")


def plain(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) as pages of one element, without title or tag."""
    return documents.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("doc:"), F.col("doc_id")).alias("url"), F.lit("").alias("title"), F.array(F.struct(F.lit(None).cast("string").alias("tag"), F.coalesce("text", F.lit("")).alias("text"))).alias("elems"))


def analyse(extracted: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Adds toks array<struct<token, tag>> in text order, title_words and n_tokens (of the body); pages without tokens go."""
    elem = F.transform("elems", lambda e: F.transform(analyzer.tokens(e["text"], config), lambda t: F.struct(t.alias("token"), e["tag"].alias("tag"))))
    out = extracted.where("elems is not null").withColumn("toks", F.flatten(elem)).withColumn("title_words", analyzer.tokens(F.coalesce("title", F.lit("")), config))
    return out.withColumn("n_tokens", F.size("toks")).where("n_tokens > 0")


def cleaned_text(analysed: DataFrame) -> DataFrame:
    """(page_id, text): every token followed by a space."""
    return analysed.select("page_id", F.concat(F.array_join("toks.token", " "), F.lit(" ")).alias("text"))


def element_offsets(extracted: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(page_id, elem, tag, start, size): where each element begins in the cleaned text, by a running sum."""
    e = extracted.select("page_id", F.posexplode("elems").alias("elem", "e")).select("page_id", "elem", "e.tag", F.length(F.array_join(analyzer.tokens(F.col("e.text"), config), " ")).alias("n"))
    e = e.withColumn("size", F.when(F.col("n") > 0, F.col("n") + 1).otherwise(0))
    w = Window.partitionBy("page_id").orderBy("elem").rowsBetween(Window.unboundedPreceding, -1)
    return e.select("page_id", "elem", "tag", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("start"), "size")


def extents(extracted: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(page_id, extents map<tag, array<struct<start, end>>>) of the important tags, both ends included."""
    tags = [t for t, _ in config.tag_weights]
    e = element_offsets(extracted, config).where(F.col("tag").isin(tags) & (F.col("size") > 0))
    per_tag = e.groupBy("page_id", "tag").agg(F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("size") - 1).alias("end")))).alias("ranges"))
    return per_tag.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "ranges")))).alias("extents"))


def kept_ids(pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """pages(page_id, url, n_tokens, fp_hi, fp_lo) -> (page_id) that a pass in page_id order would keep.

    Such a pass drops a page whose URL, or a near-duplicate of which, it has kept. Pages of one footprint and length are one class, so conflicts
    are shared classes, shared URLs and pairs of near classes; nothing is paired page by page. Each round keeps every page that is the first
    undecided one of its class, its URL and all near classes, and drops what conflicts with it; rounds are few and written to the shared folder.
    """
    p = pages.withColumn("cls", F.xxhash64("fp_hi", "fp_lo", "n_tokens"))
    left = stored(p.select("page_id", "url", "cls"), "undecided")
    classes = p.groupBy("cls").agg(F.first("fp_hi").alias("fp_hi"), F.first("fp_lo").alias("fp_lo"), F.first("n_tokens").alias("n_tokens")).withColumnRenamed("cls", "doc_id")
    near = footprint.near_pairs(classes, config)
    near = stored(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))), "near")
    kept = None
    while not left.isEmpty():
        first = left.groupBy("cls").agg(F.min("page_id").alias("page_id"))
        other = near.join(first.withColumnRenamed("cls", "b"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("page_id").alias("other"))
        lone = first.join(other, "cls", "left").where("other is null or other > page_id").select("page_id")
        firsts = left.groupBy("url").agg(F.min("page_id").alias("page_id")).select("page_id")
        now = stored(left.join(lone, "page_id", "left_semi").join(firsts, "page_id", "left_semi"), "kept")
        kept = now if kept is None else kept.unionByName(now)
        gone = now.select("cls").unionByName(near.join(now.select(F.col("cls").alias("a")), "a").select(F.col("b").alias("cls"))).distinct()
        left = stored(left.join(gone, "cls", "left_anti").join(now.select("url").distinct(), "url", "left_anti"), "undecided")
    return (left if kept is None else kept).select("page_id")


def dense_ids(df: DataFrame, key: str, name: str = "doc_id") -> DataFrame:
    """df with 0-based ordinals in the order of key: a range partitioning, and each partition's start from the partitions' counts."""
    at = F.monotonically_increasing_id()
    spread = stored(df.repartitionByRange(key).sortWithinPartitions(key).withColumn("_at", at), "ordered")
    part = F.shiftright("_at", 33)
    n = {r.part: r.n for r in spread.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per partition
    start, total = [], 0
    for k in sorted(n):
        start.append((k, total))
        total += n[k]
    starts = F.broadcast(df.sparkSession.createDataFrame(start, "_part long, _start long"))
    numbered = spread.withColumn("_part", part).join(starts, "_part").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return numbered.drop("_part", "_start", "_at")


def build(pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """pages -> docs(doc_id, page_id, url, title, title_words, toks, n_tokens, fp_hi, fp_lo): extracted, deduplicated, numbered by page_id."""
    marked = analyse(extract(pages).where("error is null"), config).withColumn("fp", footprint.footprint("toks.token"))
    docs = stored(marked.select("page_id", "url", "title", "title_words", "toks", "n_tokens", "fp.fp_hi", "fp.fp_lo"), "docs")
    return dense_ids(docs.join(kept_ids(docs, config), "page_id", "left_semi"), "page_id")
