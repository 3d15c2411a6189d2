"""A training corpus from raw documents: quality rules, near-duplicates, benchmark passages, personal data, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillwatch.llm import decontaminate, personal_data, quality_rules, sentence_pieces, simhash
from tillwatch.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def private_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal_data.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_pieces.with_tokens(docs)


STAGES = [
    ("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark_passages),
    ("PII", private_spans), ("SentencePiece", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole documents; each is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
