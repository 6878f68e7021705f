"""Line dedup: lines that several documents share stay only in the document of smallest id.

Only line hashes are shuffled to find shared lines; each hash is pre-aggregated to the smallest
and largest document that holds it, so a line in a third of all documents is one row a task. The
decisions go back as line positions, one array a document, and the text moves once, to meet them.

Cases. A null or empty text is one empty line. Rows with equal doc_id are one document when
holders are counted. Rows with null doc_id hold nothing and lose nothing. Repeated rows get equal
results. An empty table gives an empty result. Extra columns pass through, whatever their names,
but ``n_lines`` and ``n_dropped`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import ascii_lower, fresh, hash128, join_per_key, let, materialise

MIN_CHARS = 10


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\f\r")))  # linear, also on long runs of blanks


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = 2) -> DataFrame:
    """(doc_id, _text_hash, _drops) of (doc_id, text): the positions, from 0, that each document loses."""
    lines = (
        docs.filter(F.col("doc_id").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("_text_hash"), F.posexplode(F.transform(lines_of(F.col("text")), line_key)).alias("pos", "key"))
        .filter(F.char_length("key") >= min_chars)
        .select("doc_id", "_text_hash", "pos", *(c.alias(f"h{k}") for k, c in enumerate(hash128(F.col("key")))))
    )
    held = lines.groupBy("h0", "h1").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    if min_docs > 2:
        pairs = lines.groupBy("h0", "h1", "doc_id").agg(F.count("*").alias("one"))
        held = pairs.groupBy("h0", "h1").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count("*").alias("docs"), F.sum("one").alias("n")).filter(F.col("docs") >= min_docs)
    shared = materialise(held.filter(F.col("keeper") < F.col("last")).select("h0", "h1", "keeper", "n"))
    return (
        join_per_key(lines, shared, ["h0", "h1"], "n", ["doc_id", "pos"])
        .filter(F.col("doc_id") != F.col("keeper"))
        .groupBy("doc_id", "_text_hash")
        .agg(F.collect_set("pos").alias("_drops"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = 2) -> DataFrame:
    """``docs`` with ``text`` rebuilt from the lines that stay, and ``n_lines`` and ``n_dropped``.

    A document that loses every line keeps an empty text.
    """
    name, drop = fresh(docs, "text_hash"), fresh(docs, "drops")
    drops = shared_lines(docs.select("doc_id", "text"), min_chars, min_docs).withColumnsRenamed({"_text_hash": name, "_drops": drop})
    joined = docs.withColumn(name, F.xxhash64("text")).join(drops, ["doc_id", name], "left")
    kept = let(
        F.struct(lines_of(F.col("text")).alias("all"), F.col(drop).alias("drops")),
        lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x["all"]) - 1), x["drops"]), lambda i: F.get(x["all"], i)), "\n"),
    )
    untouched = F.col(drop).isNull()
    return (
        joined.withColumn("n_lines", F.size(lines_of(F.col("text"))).cast("long"))
        .withColumn("n_dropped", F.when(untouched, 0).otherwise(F.size(drop)).cast("long"))
        .withColumn("text", F.when(untouched, F.coalesce(F.col("text"), F.lit(""))).otherwise(kept))
        .select(*(c for c in docs.columns if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped")
    )
