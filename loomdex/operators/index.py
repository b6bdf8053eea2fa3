"""Documents to scored unigram and bigram postings."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.config import DEFAULT, Config
from loomdex.functions import scoring, tally
from loomdex.runtime import discard, ship, stored, trimmed


def scored(posted: DataFrame, n_docs: int, few: bool = False) -> DataFrame:
    """Adds df and score (tf-idf of wtf, 4 places). df is counted with map-side pre-aggregation and joined, so a common term is no window of its own.

    posted is read twice, so it should be a stored table; few: its terms are so few that their df can be broadcast.
    """
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return with_score(posted.join(F.broadcast(df) if few else df, "term"), n_docs)


def with_score(posted: DataFrame, n_docs: int) -> DataFrame:
    return posted.withColumn("score", F.round(scoring.tf_idf(F.col("wtf"), F.lit(float(n_docs)), F.col("df")), 4))


def ranked(index: DataFrame, ngram: int, most: int) -> DataFrame:
    """The first `most` postings of each term with their rank: by score for unigrams, by document for bigrams."""
    order = [F.desc("score"), F.asc("doc_id")] if ngram == 1 else [F.asc("doc_id")]
    return index.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(*order))).where(F.col("rank") <= most)


@dataclass
class Index:
    """Both indexes, the documents' lengths, titles and URLs, and the corpus size."""

    unigrams: DataFrame
    bigrams: DataFrame
    docs: DataFrame
    n_docs: int
    config: Config


def build(docs: DataFrame, config: Config = DEFAULT, positions: bool = True, only: dict[int, list[str]] | None = None) -> Index:
    """Index docs(doc_id, title, url, title_words, toks or words, n_tokens); an index to rank with only can do without positions.

    only: the terms, by ngram, that will be asked for; others are left out before anything is written, and what is asked gets the same answers.
    """
    info = stored(docs.select("doc_id", "title", "url", "n_tokens"), "doc-info")
    n = info.count()
    posted = stored(tally.postings(docs, (1, 2), config, positions, only).select("ngram", "term", "doc_id", *(["positions"] if positions else []), "wtf"), "postings")
    own = [posted.where(F.col("ngram") == k).drop("ngram") for k in (1, 2)]
    made = [stored(scored(p, max(n, 1), only is not None), f"index{k}") for k, p in enumerate(own, 1)]
    discard(posted)
    return Index(*made, info, n, config)


def dealt(posted: DataFrame, parts: int) -> DataFrame:
    """Postings in so many partitions by term, each in the order of terms and documents, with df: one shuffle and one sort serve all that needs whole lists."""
    rows = posted.repartition(parts, "term").sortWithinPartitions("term", "doc_id")
    return rows.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term")))


def encode(index: DataFrame, ngram: int = 1, in_order: bool = False) -> DataFrame:
    """(term, line): the text form term:[length][doc,[positions],score]... of each posting list, in index order.

    An export for other programs: a list is one value, so it must fit a row. in_order: the rows are dealt() by term already, in index order.
    """
    ship(index.sparkSession)
    if not in_order:
        index = index.repartition("term").sortWithinPartitions("term", *([F.desc("score")] if ngram == 1 else []), "doc_id")
    body = F.concat(F.lit("["), F.col("doc_id"), F.lit(",["), F.array_join("positions", ","), F.lit("],"), F.col("score"), F.lit("]"))

    def each(batches):
        term, parts = None, []
        for b in batches:
            if not b.num_rows:
                continue
            terms, rows = b.column("term"), b.column("x")
            starts = np.flatnonzero(np.concatenate([[True], np.asarray(pc.not_equal(terms[1:], terms[:-1]))]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, b.num_rows).astype(np.int32)), rows)
            names, joined = terms.take(pa.array(starts)), pc.binary_join(lists, "")
            if term is not None and names[0].as_py() != term:
                yield pa.RecordBatch.from_arrays([pa.array([term], pa.string()), pa.array(["".join(parts)], pa.string())], names=["term", "x"])
                parts = []
            if len(starts) > 1:
                head = pa.array(["".join([*parts, joined[0].as_py()])], pa.string())
                yield pa.RecordBatch.from_arrays([names[:-1].cast(pa.string()), pa.concat_arrays([head, joined[1:-1].cast(pa.string())])], names=["term", "x"])
                parts = []
            term = names[-1].as_py()
            parts.append(joined[-1].as_py())
        if term is not None:
            yield pa.RecordBatch.from_arrays([pa.array([term], pa.string()), pa.array(["".join(parts)], pa.string())], names=["term", "x"])

    got = index.select("term", F.concat(F.lit("["), F.length(body), F.lit("]"), body).alias("x")).mapInArrow(trimmed(each), "term string, x string")
    return got.select("term", F.concat("term", F.lit(":"), "x").alias("line"))


def decode(lines: DataFrame) -> DataFrame:
    """The inverse of encode(): (term, doc_id, positions, score)."""
    head = F.substring_index("line", ":", 1)
    found = F.regexp_extract_all(F.col("line"), F.lit(r"\](\[\d+,\[[^\]]*\],[^\]]*\])"), F.lit(1))
    rows = lines.select(head.alias("term"), F.explode(found).alias("x"))
    numbers = F.split(F.regexp_extract("x", r"\[\d+,\[([^\]]*)\]", 1), ",").cast("array<int>")
    return rows.select("term", F.regexp_extract("x", r"^\[(\d+)", 1).cast("long").alias("doc_id"), numbers.alias("positions"), F.regexp_extract("x", r",([^,\]]*)\]$", 1).cast("double").alias("score"))


def write(index: Index, path: str) -> None:
    """Both indexes range-partitioned and sorted by term, so that a lookup reads the row groups of its terms only; and the documents."""
    index.unigrams.repartitionByRange("term").sortWithinPartitions("term", F.desc("score"), "doc_id").write.mode("overwrite").parquet(f"{path}/unigrams")
    index.bigrams.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/bigrams")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")


def read(spark, path: str, config: Config = DEFAULT) -> Index:
    docs = spark.read.parquet(f"{path}/docs")
    return Index(spark.read.parquet(f"{path}/unigrams"), spark.read.parquet(f"{path}/bigrams"), docs, docs.count(), config)


def lookup(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of some terms; the filter reaches the scan."""
    return postings.where(F.col("term").isin(terms))
