"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import bpe, chat_format, decontamination, huffman, line_dedup, merkle, near_dedup, oracles, packing, quality_rules, secret_scans, top_k, url_filters, whitening
from gazette.llm.shared import table
from gazette.llm.tokens import vocabulary


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    # in two portions: the second scans only what the ledger lacks after the first
    return secret_scans.summary(table(spark, sf_dir, "documents"), increments=2)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = url_filters.judge(pages, url_filters.listed_urls(pages))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat_format.in_reply_order(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", "text", F.col("parent_turn").cast("string").alias("parent_turn"), "n_linked", "depth", F.array_join(F.transform("path", lambda t: t.cast("string")), ".").alias("path"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduped(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k.search(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.verified(merkle.manifest(table(spark, sf_dir, "documents"), claims={"n_chars": tampered}))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_secret_scans, op3_best_fit_packing, op4_url_filters, op5_chat_format, op6_near_dedup, op7_token_files, op8_line_dedup, op9_exact_top_k, op10_bpe, op11_whitening, op12_decontamination, op13_merkle_manifest)}
ORACLES = {"op1_quality_rules": oracles.QUALITY_RULES, "op4_url_filters": oracles.URL_FILTERS, "op5_chat_format": oracles.CHAT_FORMAT, "op8_line_dedup": oracles.LINE_DEDUP, "op9_exact_top_k": oracles.TOP_K, "op12_decontamination": oracles.DECONTAMINATION, "op13_merkle_manifest": oracles.MERKLE}
