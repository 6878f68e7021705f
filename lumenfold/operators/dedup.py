"""Duplicates within an album: one row per (album, content) survives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stands for "no date" wherever accuracies are compared; a higher accuracy is a worse one.
NO_ACCURACY = 999


def name_rank(accuracy: Column, name: Column) -> Column:
    """Accuracy and name length, written one after the other and compared as text: 10 comes before 9."""
    return F.concat(F.coalesce(accuracy.cast("string"), F.lit(str(NO_ACCURACY))), F.length(name).cast("string"))


def remove_duplicates(media: DataFrame, album: str = "album", keys: tuple[str, ...] = ("size", "content_key")) -> DataFrame:
    """The survivors. Null albums are one album.

    Only the first row of a group is kept, so Spark limits each group before it is shuffled.
    """
    accuracy = F.col("accuracy") if "accuracy" in media.columns else F.lit(None).cast("int")
    order = Window.partitionBy(album, *keys).orderBy(name_rank(accuracy, F.col("name")), "ord")
    return media.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == 1).drop("_rank")


def count_duplicates(media: DataFrame, album: str = "album", keys: tuple[str, ...] = ("size", "content_key")) -> DataFrame:
    """One row: ``removed``, how many rows remove_duplicates leaves out."""
    return media.groupBy(album, *keys).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("removed"))
