"""Stateful crawl operators: query traps, running counts, incremental indexing."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomdex.config import DEFAULT, Config
from loomdex.functions import urls
from loomdex.runtime import trimmed

#: Rows that a Python worker turns into objects at a time.
ROWS = 2_000
TRAP = "path_key string, page_id long, url string, suppressed boolean, counter int, pattern string"
_STATE = "fp_hi long, fp_lo long, counter int"


def query_pages(stats: DataFrame) -> DataFrame:
    """(path_key, prefix, page_id, url, fp_hi, fp_lo) of pages with a query."""
    u = F.col("url")
    head = F.concat(urls.part(u, "scheme"), F.lit("://"), urls.part(u, "netloc"), urls.part(u, "path"))
    return stats.where(F.contains(u, F.lit("?"))).select(F.concat(urls.part(u, "netloc"), urls.part(u, "path")).alias("path_key"), F.concat(F.lit("^"), urls.escape(head), F.lit(".*$")).alias("pattern"), "page_id", "url", "fp_hi", "fp_lo")


def step(state: tuple[int, int, int] | None, fp_hi: int, fp_lo: int, config: Config = DEFAULT) -> tuple[tuple[int, int, int] | None, bool, int, bool]:
    """(new state, suppressed, counter, blacklist) after a visit: similar ones count up to the limit, others halve the count."""
    if state is None:
        return (fp_hi, fp_lo, 0), False, 0, False
    hi, lo, n = state
    alike = 1 - ((hi ^ fp_hi).bit_count() + (lo ^ fp_lo).bit_count()) / 64 > config.trap_similarity
    if not alike:
        return (fp_hi, fp_lo, n // 2), False, n // 2, False
    if n >= config.trap_hits - 1:
        return None, True, n + 1, True
    return (fp_hi, fp_lo, n + 1), True, n + 1, False


def _visits(state, rows: pd.DataFrame, config: Config):
    out = []
    for r in rows.sort_values("page_id").itertuples():
        state, suppressed, n, black = step(state, r.fp_hi, r.fp_lo, config)
        out.append((r.path_key, r.page_id, r.url, suppressed, n, r.pattern if black else None))
    return state, pd.DataFrame(out, columns=["path_key", "page_id", "url", "suppressed", "counter", "pattern"])


def query_traps(pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Decisions for query_pages() in page_id order, in a batch; pattern is set where a path gets blacklisted.

    A path's pages are read as a sorted stream: what is held is one path's state and a block of rows, however many pages a path has.
    """
    asked = ["path_key", "page_id", "url", "fp_hi", "fp_lo", "pattern"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.string()]
    names = [x.split()[0] for x in TRAP.split(", ")]

    def each(batches):
        key, state = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                out = []
                for path, page_id, url, hi, lo, pattern in zip(*(whole.column(c).slice(at, ROWS).to_pylist() for c in asked), strict=True):
                    if path != key:
                        key, state = path, None
                    state, suppressed, n, black = step(state, hi, lo, config)
                    out.append((path, page_id, url, suppressed, n, pattern if black else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return pages.select(*asked).repartition("path_key").sortWithinPartitions("path_key", "page_id", "url").mapInArrow(trimmed(each), TRAP)


def query_traps_stream(pages: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The same over a stream, with the state of each path kept between batches."""

    def update(key, batches, state: GroupState):
        now = tuple(state.get) if state.exists else None
        rows = pd.concat(list(batches))
        now, out = _visits(now, rows, config)
        if now is None:
            if state.exists:
                state.remove()
        else:
            state.update(now)
        yield out

    return pages.groupBy("path_key").applyInPandasWithState(update, TRAP, _STATE, "append", GroupStateTimeout.NoTimeout)


def running_counts(stats: DataFrame) -> DataFrame:
    """Token counts of a stream of page stats, for complete mode."""
    return stats.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def index_stream(pages: DataFrame, path: str, checkpoint: str, config: Config = DEFAULT):
    """An extension: every micro-batch of pages is extracted and its postings, not yet scored, are added at path; scores need the corpus and are made on reading."""
    from loomdex.functions import tally
    from loomdex.operators.documents import analyse, extract

    def add(batch: DataFrame, number: int) -> None:
        docs = analyse(extract(batch).where("error is null"), config).withColumnRenamed("page_id", "doc_id")
        tally.postings(docs, (1,), config).select("term", "doc_id", "positions", "wtf").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index_stream(spark: SparkSession, path: str) -> DataFrame:
    from loomdex.operators.index import scored

    posted = spark.read.parquet(path).drop("batch")
    return scored(posted, posted.select("doc_id").distinct().count())
