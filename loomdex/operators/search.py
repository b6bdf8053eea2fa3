"""Ranked keyword search, any number of queries in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.functions import analyzer, scoring
from loomdex.operators.index import Index, ranked
from loomdex.runtime import ship, stored

#: Query parts up to which they are sent to every executor; more are joined by a shuffle.
BROADCAST_PARTS = 100_000
_PART = ["query_id", "level", "part"]


def parts(queries: DataFrame, config) -> DataFrame:
    """queries(query_id, q) -> (query_id, level, part, words, all_stop): level L cuts the words into 2 ** L contiguous parts while there are as many words."""
    q = queries.select("query_id", analyzer.query_words(F.coalesce("q", F.lit(""))).alias("words")).where(F.size("words") > 0)
    q = q.withColumn("all_stop", analyzer.all_stop_words(F.col("words")))
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.size("words").cast("double")) + 1e-9).cast("int"))
    q = q.withColumn("level", F.explode(levels)).withColumn("n", F.expr("shiftleft(1, level)"))
    return q.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(*_PART, analyzer.split_words(F.col("words"), F.col("n"), F.col("part")).alias("words"), "all_stop")


def terms(cut: DataFrame, config) -> DataFrame:
    """(query_id, level, part, bigram, term, qf, n_terms): the parts' distinct terms; bigrams for queries of stop words only."""
    text = F.array_join("words", " ")
    tokens = analyzer.tokens(text, config)
    uni = analyzer.stems(analyzer.drop_stop_words(tokens, config), config)
    # a query of stop words only keeps them all
    t = cut.select(*_PART, "all_stop", "words", tokens.alias("tokens"), uni.alias("uni")).withColumn("two", analyzer.bigrams(analyzer.stems(F.col("tokens"), config)))
    raw = analyzer.stems(F.transform("words", lambda w: F.lower(w)), config) if config.stem else F.col("words")
    t = t.withColumn("raw", analyzer.stems(F.col("tokens"), config) if config.analyzed_qf else raw)
    t = t.withColumn("terms", F.array_distinct(F.when(F.col("all_stop"), F.col("two")).otherwise(F.col("uni"))))
    t = t.select(*_PART, F.col("all_stop").alias("bigram"), F.explode("terms").alias("term"), "raw", F.size("terms").alias("n_terms"))
    return t.select(*_PART, "bigram", "term", F.size(F.filter("raw", lambda w: w == F.col("term"))).alias("qf"), "n_terms")


def bonus_terms(cut: DataFrame, config) -> DataFrame:
    """(query_id, level, part, term): bigrams of the parts' tokens without stop words, stemmed word by word."""
    tokens = analyzer.tokens(F.array_join("words", " "), config)
    pair = analyzer.drop_stop_bigrams(analyzer.bigrams(tokens))
    t = cut.where("not all_stop").select(*_PART, pair.alias("pairs")).select(*_PART, F.explode(F.array_distinct("pairs")).alias("p"))
    return t.select(*_PART, F.array_join(analyzer.stems(F.split("p", " "), config), " ").alias("term")).distinct()


def listed(asked: list[DataFrame]) -> dict[int, list[str]] | None:
    """The distinct terms of tables (ngram, term), by ngram; None if they are more than executors should all hold."""
    every = asked[0]
    for a in asked[1:]:
        every = every.unionByName(a)
    rows = every.distinct().limit(BROADCAST_PARTS + 1).collect()
    return None if len(rows) > BROADCAST_PARTS else {k: [r.term for r in rows if r.ngram == k] for k in (1, 2)}


def matches(index: Index, wanted: DataFrame) -> DataFrame:
    """(query_id, level, part, doc_id, n_terms, bigram, raw, cosine): documents with all of a part's terms within the cut-off.

    A document's entry rank is its worst rank over the terms' lists; the part's cut-off is the first of the ladder with enough documents, else the
    last. raw sums the postings' scores, cosine weighs them by the query's tf-idf.
    """
    small = wanted.count() <= BROADCAST_PARTS
    hint = F.broadcast if small else (lambda x: x)
    ladder = index.config.cutoffs
    found = None
    for ngram, postings in ((1, index.unigrams), (2, index.bigrams)):
        own = wanted.where(F.col("bigram") == F.lit(ngram == 2))
        some = postings.join(hint(own.select("term").distinct()), "term", "left_semi").select("term", "doc_id", "score", "df")
        hit = ranked(some, ngram, ladder[-1]).join(hint(own), "term")
        found = hit if found is None else found.unionByName(hit)
    weight = scoring.tf_idf(F.col("qf"), F.lit(float(max(index.n_docs, 1))), F.col("df")) * F.col("score")
    docs = found.groupBy(*_PART, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("n_terms").alias("n_terms"), F.first("bigram").alias("bigram"), F.max("rank").alias("entry"), F.sum("score").alias("raw"), F.sum(weight).alias("cosine")).where("n = n_terms")
    w = Window.partitionBy(*_PART)
    enough = [F.count(F.when(F.col("entry") <= k, 1)).over(w) >= index.config.results for k in ladder[:-1]]
    cut = F.lit(ladder[-1])
    for k, ok in reversed(list(zip(ladder[:-1], enough, strict=True))):
        cut = F.when(ok, F.lit(k)).otherwise(cut)
    return docs.withColumn("cutoff", cut).where(F.col("entry") <= F.col("cutoff"))


def part_scores(index: Index, found: DataFrame, cut: DataFrame) -> DataFrame:
    """(query_id, level, part, doc_id, score): one term: its posting's score; more: the cosine-like score by document length."""
    f = found.join(index.docs.select("doc_id", "n_tokens"), "doc_id")
    cosine = F.round(F.col("cosine") / scoring.length_norm(F.col("n_tokens")), 3)
    f = f.withColumn("score", F.when(F.col("n_terms") > 1, cosine).otherwise(F.col("raw")))
    if index.config.bigram_bonus:
        first = ranked(index.bigrams, 2, index.config.bigram_cutoff).select("term", "doc_id", F.col("score").alias("bonus"))
        extra = first.join(bonus_terms(cut, index.config), "term").groupBy(*_PART, "doc_id").agg(F.sum("bonus").alias("bonus"))
        f = f.join(extra, [*_PART, "doc_id"], "left").withColumn("score", F.col("score") + F.when(F.col("n_terms") > 1, F.coalesce("bonus", F.lit(0.0))).otherwise(0.0))
    return f.select(*_PART, "doc_id", "score")


def relax(scores: DataFrame) -> DataFrame:
    """(query_id, doc_id, level, score): a level counts while the ones before it found too few; a document keeps its first level's sum over parts."""
    level = scores.groupBy("query_id", "level", "doc_id").agg(F.sum("score").alias("score"))
    return level.groupBy("query_id", "doc_id").agg(F.min_by(F.struct("level", "score"), "level").alias("m")).select("query_id", "doc_id", "m.level", "m.score")


def search(index: Index, queries: DataFrame, all_results: bool = False) -> DataFrame:
    """queries(query_id, q) -> (query_id, rank, doc_id, title, url, score, level), the best `results` of each query, ties by doc_id."""
    ship(queries.sparkSession)
    config = index.config
    cut = parts(queries, config)
    scores = stored(part_scores(index, matches(index, terms(cut, config)), cut), "scores")
    first = relax(scores)
    counts = first.groupBy("query_id", "level").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("query_id").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    active = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < config.results).select("query_id", "level")
    hits = first.join(active, ["query_id", "level"], "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    hits = hits.withColumn("rank", F.row_number().over(order))
    if not all_results:
        hits = hits.where(F.col("rank") <= config.results)
    return hits.join(index.docs.select("doc_id", "title", "url"), "doc_id").select("query_id", "rank", "doc_id", "title", "url", F.round("score", 4).alias("score"), "level")
