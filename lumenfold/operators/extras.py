"""Extras: edited copies, known by the ending of their names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.paths import stem
from lumenfold.functions.unicode import nfc
from lumenfold.options import EXTRA_SUFFIXES


def is_extra(name: Column, suffixes: Sequence[str] = EXTRA_SUFFIXES) -> Column:
    """Whether the lower-cased stem ends, after NFC, with a known suffix."""
    s = nfc(F.lower(stem(name)))
    out = F.lit(False)
    for x in suffixes:
        out = out | F.endswith(s, F.lit(x))
    return out


def remove_extras(media: DataFrame, suffixes: Sequence[str] = EXTRA_SUFFIXES) -> DataFrame:
    return media.filter(~is_extra(F.col("name"), suffixes))


def count_extras(media: DataFrame, suffixes: Sequence[str] = EXTRA_SUFFIXES) -> DataFrame:
    return media.agg(F.count_if(is_extra(F.col("name"), suffixes)).alias("removed"))
