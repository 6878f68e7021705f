"""Path and string functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*\z", "")


def stem(name: Column) -> Column:
    """Name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def extension(name: Column) -> Column:
    return F.regexp_extract(name, r".(\.[^.]*)\z", 1)


def join_path(*parts: Column) -> Column:
    """Parts joined by a slash; empty and null parts are skipped."""
    return F.concat_ws("/", *(F.nullif(p, F.lit("")) for p in parts))


def replace_last(text: Column, old: Column, new: Column) -> Column:
    """``text`` with the last occurrence of ``old`` replaced; unchanged without one."""
    at = F.call_function("locate", F.reverse(old), F.reverse(text))
    start = F.length(text) - at - F.length(old) + 2
    return F.when((at > 0) & (F.length(old) > 0), F.concat(F.substring(text, F.lit(1), start - 1), new, F.substring(text, start + F.length(old), F.length(text)))).otherwise(text)


def human_size(size: Column) -> Column:
    """Binary units, two decimals, ties to the even one as in C; Spark's own format rounds them up."""
    size = size.cast("long")
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        rest = size.bitwiseAND(1024**k - 1) * 100
        down, below = F.shiftright(size, 10 * k) * 100 + F.shiftright(rest, 10 * k), rest.bitwiseAND(1024**k - 1) * 2
        cents = down + F.when((below > 1024**k) | ((below == 1024**k) & (down % 2 == 1)), 1).otherwise(0)
        out = F.when(size >= 1024**k, F.format_string(f"%d.%02d {unit}", (cents / 100).cast("long"), cents % 100)).otherwise(out)
    return out
