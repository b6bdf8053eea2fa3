"""Tables of a crawl and of the filter's output, and other formats to read pages from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_PAGE = "content string, encoding string, url string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """pages(page_id, url, html) from Parquet."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_json_pages(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object {content, encoding, url} a file, anywhere below path; page_id is a hash of the file's name, as files have no order."""
    raw = spark.read.schema(RAW_PAGE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return raw.select(F.xxhash64(F.input_file_name()).alias("page_id"), "url", F.col("content").alias("html"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """pages from tar or tar.gz archives of such JSON files, read where they lie; each archive must fit an executor."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def each(batches):
        import io
        import json
        import tarfile

        import pandas as pd

        for batch in batches:
            rows = []
            for blob in batch["content"]:
                with tarfile.open(fileobj=io.BytesIO(blob)) as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(".json"):
                            x = json.load(tar.extractfile(m))
                            rows.append((m.name, x.get("url"), x.get("content")))
            yield pd.DataFrame(rows, columns=["name", "url", "html"])

    return files.mapInPandas(each, "name string, url string, html string").select(F.xxhash64("name").alias("page_id"), "url", "html")


def write_docs(docs: DataFrame, extents: DataFrame, path: str) -> None:
    """The document table (title, url, n_tokens, extents) and cleaned texts; an earlier output is replaced."""
    info = docs.join(extents, "page_id", "left").select("doc_id", "title", "url", "n_tokens", "extents")
    info.write.mode("overwrite").parquet(f"{path}/docs")
    docs.select("doc_id", F.concat(F.array_join("toks.token", " "), F.lit(" ")).alias("text")).write.mode("overwrite").parquet(f"{path}/texts")


def corpus_size(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/docs").count()


def doc_lines(docs: DataFrame) -> DataFrame:
    """The JSON-line form of the document table."""
    return docs.select(F.to_json(F.array("title", "url", F.col("n_tokens").cast("string"))).alias("line"))


def fetch(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """The offline stand-in of a download: (url, final_url, status, error, content), 404 where the page store lacks the URL.

    One response a row of the frontier: of a URL that the store has twice, the page of the smallest page_id counts.
    """
    first = F.min(F.struct(*(c for c in ("page_id", "html") if c in pages.columns)))
    have = pages.groupBy(F.col("url").alias("final_url")).agg(first.alias("p")).select("final_url", F.col("p.html").alias("content"))
    got = frontier.join(have, F.col("url") == F.col("final_url"), "left")
    missing = F.col("final_url").isNull()
    return got.select("url", F.coalesce("final_url", "url").alias("final_url"), F.when(missing, 404).otherwise(200).alias("status"), F.when(missing, "not found").alias("error"), "content")


def save(df: DataFrame, path: str) -> None:
    """Checkpoint one of the crawl's tables (frontier, blacklist, subdomains, trap state)."""
    df.write.mode("overwrite").parquet(path)
