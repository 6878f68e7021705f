"""Content identity: size first, digests only where sizes meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.options import MAX_READ_BYTES
from lumenfold.skew import join_per_key
from lumenfold.sources.content import UNREADABLE, file_digest, spread_by_bytes
from lumenfold.staging import staged


def size_key(size: Column) -> Column:
    return F.concat(size.cast("string"), F.lit("bytes"))


def with_content_key(media: DataFrame, digest: Column | None = None, oversize_policy: str = "reference") -> DataFrame:
    """Add ``content_key``: ``<n>bytes`` for a size that occurs once, else the digest.

    ``digest`` is a column if the table has one; otherwise the files of shared sizes, and only
    those, are read, in tasks of about equal bytes. The key belongs with the size: equal digests of
    different sizes differ. A file that can't be read, or has no size, equals no other. Sizes are
    counted with a map-side combined aggregate, and files of a frequent size stay dealt out.
    """
    shared = media.groupBy("size").agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).withColumn("_shared", F.lit(True))
    marked = join_per_key(media, shared, ["size"], "_n", ["path" if "path" in media.columns else media.columns[0]])
    if digest is None:
        is_read = F.col("_shared") & (F.lit(oversize_policy == "full_hash") | (F.col("size") <= MAX_READ_BYTES))
        marked = spread_by_bytes(staged(marked), F.when(is_read, F.col("size")).otherwise(0))
        # the paths of unshared sizes go to Python as nulls, and aren't opened
        digest = file_digest(F.when(F.col("_shared"), F.col("path")), F.col("size"), oversize_policy)
    key = F.when(F.col("_shared"), digest).otherwise(size_key(F.col("size")))
    if "path" in media.columns:
        key = F.coalesce(key, F.concat(F.lit(UNREADABLE), F.col("path")))
    return marked.withColumn("content_key", key).select(*media.columns, "content_key")


def group_identical(media: DataFrame) -> DataFrame:
    """(size, content_key, n, first_ord) of each group of equal content."""
    return media.groupBy("size", "content_key").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))
