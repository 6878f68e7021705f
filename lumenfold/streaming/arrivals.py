"""Files that keep arriving: duplicates dropped and arrivals counted as they come, within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.extras import is_extra


def first_arrivals(stream: DataFrame, *, time: str = "mtime", late: str = "1 day", keys: tuple[str, ...] = ("album", "size", "content_key")) -> DataFrame:
    """The first row of each content; state older than the watermark is let go."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def without_extras(stream: DataFrame) -> DataFrame:
    return stream.filter(~is_extra(F.col("name")))


def arrivals_per_window(stream: DataFrame, *, time: str = "mtime", late: str = "1 day", width: str = "1 hour", by: tuple[str, ...] = ("album",)) -> DataFrame:
    """(window_start, *by, files, bytes), final once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).select(F.col("w.start").alias("window_start"), *by, "files", "bytes")
