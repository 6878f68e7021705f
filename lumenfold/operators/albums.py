"""Albums: records of equal content become one, which lists its files and has the best date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.dedup import NO_ACCURACY
from lumenfold.options import ALBUM_MODES, DUPLICATE_COPY, JSON, NOTHING, SHORTCUT


def merge_albums(media: DataFrame) -> DataFrame:
    """MERGED rows of (ord, album, path, size, content_key, date_taken, accuracy).

    A repeated album keeps its first place and its last path. Albums are combined before content,
    so a group collects one element per album, however many copies it has. The list order of the
    result is (merged, size_ord, group_ord): single records first, merged ones by the first
    appearance of their size and content.
    """
    content = ["size", "content_key"]
    by_album = media.groupBy(*content, "album").agg(
        F.min("ord").alias("first"),
        F.max_by("path", "ord").alias("path"),
        F.count("*").alias("n"),
        F.min(F.struct(F.coalesce("accuracy", F.lit(NO_ACCURACY)).alias("worst"), "ord", "accuracy", "date_taken")).alias("best"),
    )
    groups = by_album.groupBy(*content).agg(
        F.array_sort(F.collect_list(F.struct(F.col("first").alias("ord"), "album", "path"))).alias("files"),
        F.min("best").alias("best"),
        F.sum("n").alias("n"),
        F.min("first").alias("group_ord"),
    )
    sizes = media.groupBy("size").agg(F.min("ord").alias("size_ord"))
    merged = F.col("n") > 1
    return groups.join(sizes, "size").select(
        *content,
        "files",
        F.col("best.date_taken").alias("date_taken"),
        F.col("best.accuracy").alias("accuracy"),
        merged.alias("merged"),
        F.when(merged, F.col("size_ord")).otherwise(F.col("group_ord")).alias("size_ord"),
        "group_ord",
    )


def media_order() -> Column:
    return F.struct("merged", "size_ord", "group_ord")


def album_names(files: Column) -> Column:
    """Names of the albums, in order; the null album has none."""
    return F.transform(F.filter(files, lambda f: f["album"].isNotNull()), lambda f: f["album"])


def output_file_count(merged: DataFrame, mode: str) -> DataFrame:
    """One row: ``files``, how many files and links a mode puts out."""
    if mode in (SHORTCUT, DUPLICATE_COPY):
        n = F.sum(F.size("files"))
    elif mode == JSON:
        n = F.count("*")
    elif mode == NOTHING:
        n = F.count_if(F.exists("files", lambda f: f["album"].isNull()))
    else:
        raise ValueError(f"{mode!r} is none of {ALBUM_MODES}")
    return merged.agg(F.coalesce(n, F.lit(0)).cast("long").alias("files"))
