"""Sidecar lookup: the first candidate name that exists in the file's folder, valid or not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.sidecar_names import candidates


def find_sidecars(media: DataFrame, entries: DataFrame, tryhard: bool = False) -> DataFrame:
    """(path, sidecar) for media that have one. Candidates are tried in order; existence decides.

    Candidates that repeat an earlier one are dropped before the join; the best per file is a
    map-side combined minimum.
    """
    tried = media.select("path", "parent", F.posexplode(F.array_distinct(candidates(F.col("name"), tryhard))).alias("rank", "candidate"))
    there = entries.filter(~F.col("is_dir") & F.endswith("name", F.lit(".json"))).select("parent", F.col("name").alias("candidate"), F.col("path").alias("sidecar"))
    return tried.join(there, ["parent", "candidate"]).groupBy("path").agg(F.min_by("sidecar", "rank").alias("sidecar"))
