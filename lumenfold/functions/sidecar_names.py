"""Candidate names of a media file's sidecar, each made from the original name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.functions.paths import replace_last, stem
from lumenfold.functions.unicode import nfc
from lumenfold.options import EXTRA_SUFFIXES

#: Longest sidecar name, ".json" included.
MAX_SIDECAR_NAME = 51


def identity(name: Column) -> Column:
    return name


def shortened(name: Column) -> Column:
    most = MAX_SIDECAR_NAME - len(".json")
    return F.when(F.length(name) > most, F.substring(name, 1, most)).otherwise(name)


def bracket_swapped(name: Column) -> Column:
    """``a(1).jpg`` becomes ``a.jpg(1)``: the last bracketed number before a dot moves to the end."""
    last = F.try_element_at(F.regexp_extract_all(name, F.lit(r"\(\d+\)\."), F.lit(0)), F.lit(-1))
    bracket = F.replace(last, F.lit("."), F.lit(""))
    return F.when(last.isNull(), name).otherwise(F.concat(replace_last(name, bracket, F.lit("")), bracket))


def extra_removed(name: Column, suffixes: Sequence[str] = EXTRA_SUFFIXES) -> Column:
    """Without the last occurrence of the first known suffix that it contains; case counts."""
    n = nfc(name)
    out = n
    for s in reversed(suffixes):
        out = F.when(F.contains(n, F.lit(s)), replace_last(n, F.lit(s), F.lit(""))).otherwise(out)
    return out


def extension_removed(name: Column) -> Column:
    return stem(name)


def any_extra_removed(name: Column) -> Column:
    """Without any ``-letters`` or ``-letters(digit)`` that stands before the extension, wherever it occurs."""
    n = nfc(name)
    extra = F.regexp_extract(n, r"(-[A-Za-zÀ-ÖØ-öø-ÿ]+(\(\d\))?)\.\w+\z", 1)
    return F.when(extra == "", n).otherwise(F.replace(n, extra, F.lit("")))


def digit_removed(name: Column) -> Column:
    return F.regexp_replace(name, r"\(\d\)\.", ".")


EASY = (identity, shortened, bracket_swapped, extra_removed, extension_removed)
HARD = (*EASY, any_extra_removed, digit_removed)


def candidates(name: Column, tryhard: bool = False) -> Column:
    """Array of sidecar file names, in the order in which they are tried."""
    return F.array(*(F.concat(f(name), F.lit(".json")) for f in (HARD if tryhard else EASY)))
