"""Folders and media: which folders are years or albums, and the media list they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.mime import is_media

YEAR_FOLDER = r"^Photos from (?:20|19|18)\d{2}\z"


def is_year_folder(name: Column) -> Column:
    return name.rlike(YEAR_FOLDER)


def year_folders(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("is_dir") & is_year_folder(F.col("name"))).select("path", "parent", "name")


def album_folders(entries: DataFrame) -> DataFrame:
    """Folders with a year folder among their siblings, year folders themselves left out."""
    homes = year_folders(entries).select("parent").distinct()
    others = entries.filter(F.col("is_dir") & ~is_year_folder(F.col("name")))
    return others.select("path", "parent", "name").join(homes, "parent", "left_semi").select("path", "parent", "name")


def media_files(entries: DataFrame) -> DataFrame:
    return entries.filter(~F.col("is_dir") & is_media(F.col("name")))


def media_list(entries: DataFrame) -> DataFrame:
    """MEDIA rows: files directly in year folders (album null), then those directly in albums.

    ``ord`` follows (year before album, folder path, name). It comes from a range-partitioned
    sort, so it is increasing but not dense, and no task sees the whole list.
    """
    folders = year_folders(entries).select(F.col("path").alias("parent"), F.lit(None).cast("string").alias("album"), F.lit(0).alias("kind")).unionByName(
        album_folders(entries).select(F.col("path").alias("parent"), F.col("name").alias("album"), F.lit(1).alias("kind"))
    )
    found = media_files(entries).select("path", "parent", "name", F.col("length").alias("size")).join(folders, "parent")
    return with_order(found, "kind", "parent", "name").select("ord", "album", "path", "parent", "name", "size")


def fix_list(entries: DataFrame) -> DataFrame:
    """All media below a folder, whatever folder they are in: MEDIA rows without albums."""
    found = media_files(entries).select("path", "parent", "name", F.col("length").alias("size"), F.lit(None).cast("string").alias("album"))
    return with_order(found, "path").select("ord", "album", "path", "parent", "name", "size")


def with_order(df: DataFrame, *by: str) -> DataFrame:
    return df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("ord", F.monotonically_increasing_id())
