"""The registered queries of the corpus operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, decontamination, divergence, embedding_dedup, html_extraction, line_dedup, near_dedup, prefix_trie, quality_classifier, quality_rules, revisits, sharding, url_rules
from .common import table, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extraction.extract(pages).select("page_id", "url", "text", "n_chars")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    held_out = quality_classifier.fold(F.col("doc_id")) == quality_classifier.HELD_OUT
    return quality_classifier.score(docs, weights).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, VOCABULARY).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontamination.contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "source", "text", "n_lines", "n_dropped")


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = revisits.crawl_log(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    resolved = revisits.resolve(log)
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return resolved.select("record_id", "url", "at", "response_id", "resolution", headers.alias("headers"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = written(quality_rules.statistics(docs).drop("text"), "rule-statistics")
    model = quality_rules.fit(stats, table(spark, sf_dir, "labels"))
    return quality_rules.judge(stats, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly"
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_bpe": op3_bpe,
    "op4_decontamination": op4_decontamination,
    "op5_url_filter": op5_url_filter,
    "op6_line_dedup": op6_line_dedup,
    "op7_revisits": op7_revisits,
    "op8_near_dedup": op8_near_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_sharding": op10_sharding,
    "op11_embedding_dedup": op11_embedding_dedup,
    "op12_divergence": op12_divergence,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op4_decontamination": decontamination.ORACLE,
    "op5_url_filter": url_rules.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op7_revisits": revisits.ORACLE,
    "op10_sharding": sharding.oracle(8),
    "op11_embedding_dedup": embedding_dedup.ORACLE,
    "op12_divergence": divergence.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
