"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    collocations, conversations, decontaminate, language_id, personal_data, quality_rules, repeated_phrases, secret_scan, sentence_pieces, simhash, suffix_levels, toxicity,
    url_templates,
)
from .common import table


def removed_units() -> Column:
    return F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = repeated_phrases.without_repeats(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return marked.select("row.doc_id", F.col("n_units").alias("n_words"), removed_units().alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"), carry=["doc_id"]).select(
        "row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judged(table(spark, sf_dir, "pages"), carry=["page_id"]).select("row.page_id", "host", "path", "rule", "verdict", "template", "block_rate")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.detected(table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predicted(table(spark, sf_dir, "documents"), carry=["doc_id"]).select("row.doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.scored(docs, labels, carry=["doc_id"]).select("row.doc_id", "held_out", "score", "predicted")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = suffix_levels.without_repeats(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return marked.select(
        "row.doc_id", F.col("n_units").alias("n_bytes"), removed_units().alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.mark(docs, table(spark, sf_dir, "benchmark")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.counts_only(table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audited(table(spark, sf_dir, "conversations"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scanned(table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_substring_dedup, op2_simhash_near_dedup, op3_url_filters, op4_personal_data, op5_language_id, op6_toxicity, op7_suffix_array_dedup,
    op8_sentence_pieces, op9_benchmark_decontamination, op10_quality_rules, op11_conversation_repair, op12_secret_scan, op13_phrase_collocations,
)}
