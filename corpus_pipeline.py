"""Corpus pipeline: quality rules, line dedup, near-dedup, pseudonyms, packing, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all that the stage
before it kept, written as Parquet and read again. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold import staging
from lumenfold.llm import line_dedup, near_dedup, packing, pii, quality
from lumenfold.llm.common import materialise, table


def whole_rows(docs: DataFrame) -> DataFrame:
    """The columns that operators read, and each row as it is, so that no column name can clash."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality.quality_rules(docs, table(spark, sf_dir, "labels"))
    return quality.apply_rules(whole_rows(docs), rules).filter("kept").select("_row.*")


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(whole_rows(docs)).select(F.col("_row").withField("text", F.col("text")).alias("_row")).select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of smallest id; five-word shingles, similarity 0.8."""
    copies = near_dedup.near_dedup(docs.select("doc_id", "text"), width=5, percent=80).filter(~F.col("kept")).select("doc_id")
    return docs.join(copies.distinct(), "doc_id", "left_anti").select(docs.columns)


def replace_private_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(whole_rows(docs)).select(F.col("_row").withField("text", F.col("text")).alias("_row")).select("_row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_shared_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("pii_pseudonyms", replace_private_values),
    ("packing", pack_sequences),
]

#: The stages learn a model, join on similarity and pack by tokens, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage wrote on its way is deleted once its result is written."""
    docs, since = table(spark, sf_dir, "documents"), staging.mark()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
            staging.release(spark, since, keep_last=True)
    return docs
