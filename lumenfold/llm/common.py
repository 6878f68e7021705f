"""What the operators of this subpackage share: tables, word and line columns, staged tables, joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.skew import join_per_key
from lumenfold.staging import staged as materialise

__all__ = ["ascii_lower", "fresh", "hash128", "join_per_key", "let", "materialise", "table", "whole_groups", "words"]

#: ASCII white space, as in every contract of this subpackage.
BLANK = r"\x20\x09-\x0D"
WORD_BREAK = rf"[{BLANK}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there or not name.startswith("_"):
        name = f"_{name}"
    return name


def whole_groups(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` sorted by ``group`` and ``order``, each group whole in one task, for a function over batches.

    They are dealt by a hash of the group. By the group itself they might not be: the planner leaves
    such a shuffle out after a join on the group, and adaptive execution, which doesn't know that the
    function needs whole groups, then reads that join's rows in any order.
    """
    return rows.repartition(F.xxhash64(group)).sortWithinPartitions(group, *order)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also when ``body`` names it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Maximal runs of characters that aren't ASCII white space; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def hash128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes: at 10^12 keys the chance of any collision is about 10^-15."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5DEECE66D), *cols)]
