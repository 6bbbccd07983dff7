"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm import (
    bitplane, dart_minhash, language_id, mixing, packing, piece_table, quote_links, rule_ledger, secret_scan, syncmers, toxicity,
    warc, whitening,
)
from cohortspark.llm.common import table, work_path


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op2_bitplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplane.round_trip(table(spark, sf_dir, "documents"))


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edit_report(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.filter("status = 'ok'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = rule_ledger.store_ledger(table(spark, sf_dir, "documents"), work_path(spark, "rule-ledger"))
    return rule_ledger.with_ablation(led).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "fail_bits", "lone_rule", "returns_without")


def op9_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.link_quotes(table(spark, sf_dir, "conversations"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language_id.train(docs.filter(~held_out))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op13_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_table.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_bitplane": op2_bitplane,
    "op3_dart_minhash": op3_dart_minhash,
    "op4_syncmers": op4_syncmers,
    "op5_warc": op5_warc,
    "op6_packing": op6_packing,
    "op7_mixing": op7_mixing,
    "op8_rule_ledger": op8_rule_ledger,
    "op9_quote_links": op9_quote_links,
    "op10_secret_scan": op10_secret_scan,
    "op11_whitening": op11_whitening,
    "op12_language_id": op12_language_id,
    "op13_piece_table": op13_piece_table,
}
ORACLE_SQL: dict[str, str] = {
    "op5_warc": warc.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op13_piece_table": piece_table.ORACLE,
}
