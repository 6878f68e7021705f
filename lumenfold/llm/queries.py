"""The thin ``opN_<name>`` queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import bpe, embedding_dedup, html_extract, line_dedup, near_dedup, packing, pii, quality, secrets, toxicity
from lumenfold.llm.common import table

#: Vocabulary files of the installed public tokenizers.
RANKS, VOCABULARY = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.quality_rules(docs, table(spark, sf_dir, "labels"))
    counts = [F.col(f"stats.{n}") for n in COUNTS]
    return quality.apply_rules(docs.select("doc_id", "text"), rules).select("doc_id", *counts, "base_failed", "kept", "rule")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_on_labels(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "spans")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_dedup(table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_live", "n_example")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), width=3, percent=85)


# ---------------------------------------------------------------- what SQL can say of op1 and op9


def quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base rule of op1, which nothing is learned for."""
    stats = quality.with_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"), only=COUNTS)
    return stats.select("doc_id", *(F.col(f"stats.{n}") for n in COUNTS), quality.base_failed().alias("base_failed"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans of op9, which no ownership changes."""
    return op9_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (op1_quality_rules, op2_byte_bpe, op3_toxicity, op4_html_extraction, op5_line_dedup, op6_pii_pseudonyms, op7_embedding_near_dedup, op8_packing, op9_secret_scan, op10_minhash_near_dedup)
    return {f.__name__: f for f in (*operators, quality_statistics, secret_base_spans)}
