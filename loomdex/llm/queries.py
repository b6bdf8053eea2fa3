"""The registered queries of this subpackage, one for each operator, with production parameters over whole tables."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm import decontaminate, language, line_dedup, link_graph, packing, pseudonyms, quantized, simhash, token_files
from loomdex.llm.common import scratch_path
from loomdex.llm.shards import ShardStore


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer lies; on a cluster the file is at the same place on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.judge(table(spark, sf_dir, "pages"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, path)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")).drop("text"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs)
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the key in spark.loomdex.pseudonymKey; without one, a random key per call, so that pseudonyms link within the result only."""
    key = spark.conf.get("spark.loomdex.pseudonymKey", None) or secrets.token_hex(32)
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op7_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantized.embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = ShardStore(spark, scratch_path(spark, "shards"))
    store.append(table(spark, sf_dir, "documents"))
    store.compact(finish=True, grace=0)  # nobody else knows this store
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_lines(docs, n_lines="n_lines", n_dropped="n_dropped").select("doc_id", "n_lines", "n_dropped", "text")


def queries() -> dict:
    own = [op1_url_filter, op2_token_files, op3_decontaminate, op4_simhash, op5_language, op6_pseudonyms, op7_embedding_duplicates, op8_packing, op9_sharding, op10_line_dedup]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_sharding": "select doc_id, lang, source, n_chars, md5(text) as text_md5 from documents",
        "op10_line_dedup": line_dedup.sql(),
    }
