"""The registered queries of this folder: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, mixing, near_dups, neighbours, oracle_sql, packing, pages, prefix_trie, quality, token_counts, token_files, toxicity, url_filters, whitening
from .common import read_table, shared_path


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents")).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.with_scores(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return token_counts.with_counts(docs).drop("text")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (mixing.mixture(read_table(spark, sf_dir, "documents"))
            .select(F.col("doc_id").cast("bigint").alias("doc_id"), "size", "source_size", "target", "taken"))


def op5_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (quality.quality(read_table(spark, sf_dir, "documents")).withColumn("doc_id", F.col("doc_id").cast("bigint"))
            .select("doc_id", *quality.BASE, "base_failed", "kept"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id bigint, turn bigint, role string, text string")
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_conversations(turns))


def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.with_main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), path)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whitening.whitened(rows, whitening.fit_whitening(rows))


#: The fixed rules of operator 13's query.
URL_RULES = (url_filters.Rule("allow", "org", "/"), url_filters.Rule("block", "example.org", "/es/"), url_filters.Rule("block", "example.org", "/en/1"),
             url_filters.Rule("allow", "com", "/fr/"), url_filters.Rule("block", "com", "/de/"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages_ = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    hosts = url_filters.host_verdicts(pages_, URL_RULES)
    return url_filters.with_verdicts(pages_.select("page_id", "url"), hosts, URL_RULES).drop("url")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_toxicity": op2_toxicity,
    "op3_token_counts": op3_token_counts,
    "op4_mixing": op4_mixing,
    "op5_near_dups": op5_near_dups,
    "op6_neighbours": op6_neighbours,
    "op7_quality": op7_quality,
    "op8_chat": op8_chat,
    "op9_pages": op9_pages,
    "op10_token_files": op10_token_files,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_url_filters": op13_url_filters,
}
ORACLES: dict[str, str] = oracle_sql.ORACLES
