"""Dates from names, EXIF strings and sidecar bodies, as Column expressions.

Wall-clock dates are built as TIMESTAMP_NTZ with calendar overflow: day 31 of February is a day in
March, hour 99 is four days later.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfold.options import NAME_CENTURIES

# The shapes of dates in file names, in the order in which they are tried.
_MONTH, _DAY = r"(?:01|02|03|04|05|06|07|08|09|10|11|12)", r"[0-3]\d"


def name_patterns(centuries: tuple[str, ...] = NAME_CENTURIES) -> tuple[str, ...]:
    year = rf"(?:{'|'.join(centuries)})\d{{2}}"
    return (
        rf"{year}{_MONTH}{_DAY}-\d{{6}}",
        rf"{year}{_MONTH}{_DAY}_\d{{6}}",
        rf"{year}-{_MONTH}-{_DAY}-\d{{2}}-\d{{2}}-\d{{2}}",
        rf"{year}-{_MONTH}-{_DAY}-\d{{6}}",
        rf"{year}{_MONTH}{_DAY}\d{{6}}",
        rf"{year}_{_MONTH}_{_DAY}_\d{{2}}_\d{{2}}_\d{{2}}",
    )


def overflowing(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    start = F.make_timestamp_ntz(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return start + F.make_ym_interval(F.lit(0), month - 1) + F.make_dt_interval(day - 1, hour, minute, second)


def guess_from_name(name: Column, centuries: tuple[str, ...] = NAME_CENTURIES) -> Column:
    """Date in a file name (TIMESTAMP_NTZ), or null: the leftmost match of the first shape that occurs."""
    digits = F.regexp_replace(F.coalesce(*(F.regexp_substr(name, F.lit(p)) for p in name_patterns(centuries))), r"[^0-9]", "")
    part = lambda start, n: F.substring(digits, start, n).cast("int")
    return F.when(digits.isNotNull(), overflowing(part(1, 4), part(5, 2), part(7, 2), part(9, 2), part(11, 2), part(13, 2)))


def normalise_exif(raw: Column) -> Column:
    """``2022:12:16 16:06:47`` and variants as ``2022-12-16 16:06:47``, cut to 19 characters."""
    out = raw
    for mark in ("-", "/", ".", "\\"):
        out = F.replace(out, F.lit(mark), F.lit(":"))
    out = F.replace(out, F.lit(": "), F.lit(":0"))
    out = F.substring(out, F.lit(1), F.least(F.length(raw), F.lit(19)))
    for _ in range(2):
        out = F.regexp_replace(out, r"^([^:]*):", "$1-")
    return out


def parse_exif(raw: Column, reject_zero: bool = True) -> Column:
    """TIMESTAMP_NTZ of an EXIF date string, or null."""
    text = normalise_exif(raw)
    shape = r"^(\d{4})-(\d{2})-(\d{2})(?:[ T](\d{2})(?::(\d{2})(?::(\d{2}))?)?)?\z"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, shape, k), F.lit("")), F.lit("0")).cast("int")
    found = text.rlike(shape)
    if reject_zero:
        found = found & ~text.rlike("^0000-00-00")
    return F.when(found, overflowing(*(part(k) for k in range(1, 7))))


def sidecar_epoch(body: Column) -> Column:
    """Epoch seconds of ``photoTakenTime.timestamp``; null unless it is an integer, as number or string."""
    return F.get_json_object(body, "$.photoTakenTime.timestamp").try_cast("bigint")


#: Seconds of the years 1 to 9999; what lies outside is no date.
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799


def sidecar_date(body: Column) -> Column:
    epoch = sidecar_epoch(body)
    return F.timestamp_seconds(F.when(epoch.between(FIRST_SECOND, LAST_SECOND), epoch))
