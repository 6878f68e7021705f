"""Date resolution: a ranked chain of extractors; the first that gives a date decides, its rank is the accuracy.

An extractor takes (media, entries) and returns (path, date). Each works only on the rows that the
ones before it left undated, so files are read, and names tried hard, for those alone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.dates import guess_from_name, parse_exif, sidecar_date
from lumenfold.functions.mime import is_image
from lumenfold.operators.sidecar import find_sidecars
from lumenfold.options import MAX_READ_BYTES, NAME_CENTURIES, Options
from lumenfold.sources.content import read_text, spread_by_bytes, with_exif_dates
from lumenfold.staging import staged

#: What opening a file costs, in bytes read, when its dates or its sidecar are looked up.
LOOKUP_BYTES = 1 << 17

Extractor = Callable[[DataFrame, DataFrame], DataFrame]


def from_sidecar(media: DataFrame, entries: DataFrame, tryhard: bool = False) -> DataFrame:
    found = spread_by_bytes(staged(find_sidecars(media, entries, tryhard)), F.lit(LOOKUP_BYTES))
    return found.select("path", sidecar_date(read_text(F.col("sidecar"))).alias("date"))


def from_exif(media: DataFrame, entries: DataFrame, reject_zero: bool = True) -> DataFrame:
    readable = media.filter(is_image(F.col("name")) & (F.col("size") <= MAX_READ_BYTES)).select("path")
    return with_exif_dates(spread_by_bytes(staged(readable), F.lit(LOOKUP_BYTES))).select("path", parse_exif(F.col("exif_raw"), reject_zero).cast("timestamp").alias("date"))


def from_name(media: DataFrame, entries: DataFrame, centuries: tuple[str, ...] = NAME_CENTURIES) -> DataFrame:
    return media.select("path", guess_from_name(F.col("name"), centuries).cast("timestamp").alias("date"))


def extractors(options: Options) -> list[Extractor]:
    """In order of trust. Without guessing, the hard sidecar search moves up to rank 2."""
    chain: list[Extractor] = [from_sidecar, partial(from_exif, reject_zero=options.reject_zero_exif)]
    if options.guess_from_name:
        chain.append(partial(from_name, centuries=options.name_centuries))
    return [*chain, partial(from_sidecar, tryhard=True)]


def resolve_dates(media: DataFrame, entries: DataFrame, chain: Sequence[Extractor]) -> DataFrame:
    """Add ``date_taken`` and ``accuracy``, both null where no extractor gives a date."""
    undated, found = media, None
    for rank, extractor in enumerate(chain):
        dated = extractor(undated, entries).filter(F.col("date").isNotNull()).select("path", F.struct(F.lit(rank).alias("accuracy"), F.col("date").alias("date_taken")).alias("_got"))
        dated = staged(dated)  # else later ranks would read the files again
        found = dated if found is None else found.unionByName(dated)
        if rank < len(chain) - 1:
            undated = undated.join(dated, "path", "left_anti")
    if found is None:
        return media.withColumns({"date_taken": F.lit(None).cast("timestamp"), "accuracy": F.lit(None).cast("int")})
    # a path may stand in the list twice; both rows get the date
    best = found.groupBy("path").agg(F.min("_got").alias("_got"))
    return media.join(best, "path", "left").select(*media.columns, F.col("_got.date_taken").alias("date_taken"), F.col("_got.accuracy").alias("accuracy"))


def undated(media: DataFrame) -> DataFrame:
    return media.filter(F.col("date_taken").isNull())


def count_undated(media: DataFrame) -> DataFrame:
    return media.agg(F.count_if(F.col("date_taken").isNull()).alias("undated"))
