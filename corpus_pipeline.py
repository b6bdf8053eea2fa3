"""A corpus pipeline: language ID, line dedup, SimHash near-dedup, benchmark decontamination, packing.

Each stage works on what its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import decontaminate, jaccard, language, line_dedup, packing
from loomdex.llm.common import scratch_path
from loomdex.llm.queries import table, tokenizer_file


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return language.reject(docs, language.train(docs))


def line_frequency(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go; n_chars follows the text."""
    out = line_dedup.drop_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return jaccard.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any benchmark passage go, however long they are: a window of 13 words, or a whole item of fewer. Without words, a document stays."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), share=None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, each with its sequence and place."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_frequency), ("simhash", near_duplicates), ("decontamination", benchmark_leaks), ("packing", packed)]

#: Language models, fingerprints and tokens can't be expressed in SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
