"""What is read from files: SHA-256 digests, sidecar bodies and EXIF date tags, in Arrow batches.

Tasks follow the bytes and files that they open, not the rows of metadata that name them: every
reader is preceded by ``spread_by_bytes``.
"""

from __future__ import annotations

import hashlib
import io
import math
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumenfold.options import MAX_READ_BYTES

#: Stands for the digest of a file that is too large to read.
OVERSIZE_DIGEST = "00"


#: Begins the digest of a file that can't be read, which ends with its path: it equals no other file.
UNREADABLE = "unreadable:"
#: Bytes and files that one task opens, about.
TASK_BYTES, TASK_FILES = 256 << 20, 2000


def spread_by_bytes(files: DataFrame, cost: Column, path: str = "path") -> DataFrame:
    """``files``, a written table, dealt to as many tasks as their ``cost`` in bytes and their number ask for."""
    row = files.agg(F.count(path).alias("n"), F.sum(cost).alias("bytes")).first()
    tasks = max(1, math.ceil((row["bytes"] or 0) / TASK_BYTES), math.ceil(row["n"] / TASK_FILES))
    return files.repartition(tasks, F.xxhash64(path))


def _digest(path: str) -> str:
    found = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            while part := f.read(1 << 20):
                found.update(part)
    except OSError:
        return UNREADABLE + path
    return found.hexdigest()


@F.pandas_udf(StringType())
def _digests(paths: pd.Series) -> pd.Series:
    return paths.map(lambda p: None if p is None else _digest(p))


def file_digest(path: Column, size: Column, oversize_policy: str = "reference") -> Column:
    """SHA-256 in hex; under "reference", files above the limit get one digest and aren't read."""
    if oversize_policy == "full_hash":
        return _digests(path)
    return F.when(size > MAX_READ_BYTES, F.lit(OVERSIZE_DIGEST)).otherwise(_digests(F.when(size <= MAX_READ_BYTES, path)))


def _body(path: str) -> str | None:
    try:
        with open(path, "rb") as f:
            return f.read().decode("utf-8")
    except (OSError, UnicodeDecodeError):
        return None


@F.pandas_udf(StringType())
def read_text(paths: pd.Series) -> pd.Series:
    """Whole file as UTF-8; null if it can't be read or decoded."""
    return paths.map(lambda p: None if p is None else _body(p))


# TIFF tags of the three dates, and of the pointer to the EXIF directory.
IMAGE_DATE, EXIF_POINTER, ORIGINAL_DATE, DIGITISED_DATE = 0x0132, 0x8769, 0x9003, 0x9004


def _at(f: BinaryIO, at: int, n: int) -> bytes:
    """Up to ``n`` bytes; the limit, which no file here exceeds, keeps a wrong length from claiming memory."""
    f.seek(at)
    return f.read(max(0, min(n, MAX_READ_BYTES)))


def _tiff_dates(f: BinaryIO) -> dict[int, str]:
    """Directories and texts are read where they stand, which may be behind the image data."""
    head = _at(f, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if order is None or len(head) < 8:
        return {}
    found: dict[int, str] = {}
    waiting, seen = [struct.unpack(f"{order}I", head[4:])[0]], set()
    while waiting:
        at = waiting.pop()
        if at in seen or len(count := _at(f, at, 2)) < 2:
            continue
        seen.add(at)
        entries = f.read(12 * struct.unpack(f"{order}H", count)[0])
        for k in range(0, len(entries) - 11, 12):
            tag, kind, n, value = struct.unpack_from(f"{order}HHII", entries, k)
            if tag == EXIF_POINTER:
                waiting.append(value)
            elif tag in (IMAGE_DATE, ORIGINAL_DATE, DIGITISED_DATE) and kind == 2:
                text = (entries[k + 8 : k + 8 + n] if n <= 4 else _at(f, value, n)).split(b"\0")[0].decode("latin-1").strip()
                if text:
                    found.setdefault(tag, text)
    return found


def _jpeg_exif(f: BinaryIO) -> BinaryIO | None:
    at = 2
    while len(head := _at(f, at, 10)) >= 4 and head[0] == 0xFF:
        marker, size = head[1], struct.unpack_from(">H", head, 2)[0]
        if marker == 0xE1 and head[4:] == b"Exif\0\0":
            return io.BytesIO(_at(f, at + 10, size - 8))
        if marker == 0xDA:
            break
        at += 2 + size
    return None


def _chunk_exif(f: BinaryIO, at: int, name: bytes, size_first: bool, order: str, after: int) -> BinaryIO | None:
    """The EXIF of files that are rows of chunks; chunks of odd length or with a checksum take ``after`` more bytes."""
    while len(head := _at(f, at, 8)) == 8:
        kind, size = (head[4:], head[:4]) if size_first else (head[:4], head[4:])
        length = struct.unpack(order, size)[0]
        if kind == name:
            data = _at(f, at + 8, length)
            return io.BytesIO(data.removeprefix(b"Exif\0\0"))
        at += 8 + length + (after if size_first else length % 2)
    return None


def _boxes(f: BinaryIO, at: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, stop) of the bodies of ISO media boxes between two places."""
    while at + 8 <= stop and len(head := _at(f, at, 16)) >= 8:
        size, kind, start = struct.unpack_from(">I", head)[0], head[4:8], at + 8
        if size == 1 and len(head) == 16:
            size, start = struct.unpack_from(">Q", head, 8)[0], at + 16
        end = stop if size == 0 else min(stop, at + size)
        if end < start:
            return
        yield kind, start, end
        at = end


class _Numbers:
    """Big-endian unsigned numbers of given widths, one after another."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def __call__(self, width: int) -> int:
        part = self.data[self.at : self.at + width]
        if len(part) < width:
            raise struct.error("cut off")
        self.at += width
        return int.from_bytes(part, "big")


def _heif_exif(f: BinaryIO) -> BinaryIO | None:
    """The item of type Exif: iinf names it, iloc says where it stands, in the file or in idat."""
    end = f.seek(0, io.SEEK_END)
    meta = next(((a, b) for kind, a, b in _boxes(f, 0, end) if kind == b"meta"), None)
    if meta is None:
        return None
    inner = {kind: (a, b) for kind, a, b in _boxes(f, meta[0] + 4, meta[1])}
    if b"iinf" not in inner or b"iloc" not in inner:
        return None
    a, b = inner[b"iinf"]
    item = None
    for kind, start, stop in _boxes(f, a + (8 if _at(f, a, 1) > b"\0" else 6), b):
        n = _Numbers(_at(f, start, min(stop - start, 16)))
        version, _ = n(1), n(3)
        if kind == b"infe" and version >= 2:
            number, _ = n(2 if version == 2 else 4), n(2)
            if n(4) == int.from_bytes(b"Exif", "big"):
                item = number
    a, b = inner[b"iloc"]
    n = _Numbers(_at(f, a, b - a))
    version, _, sizes = n(1), n(3), n(2)
    offset_size, length_size, base_size, index_size = (sizes >> shift & 15 for shift in (12, 8, 4, 0))
    for _ in range(n(2 if version < 2 else 4)):
        number, method = n(2 if version < 2 else 4), n(2) & 15 if version in (1, 2) else 0
        _, base, data = n(2), n(base_size), b""
        for _ in range(n(2)):
            _, offset, length = n(index_size) if version in (1, 2) else 0, n(offset_size), n(length_size)
            if number == item and method < 2:
                data += _at(f, base + offset + (inner.get(b"idat", (0, 0))[0] if method == 1 else 0), length)
        if number == item and len(data) > 4:
            return io.BytesIO(data[4 + int.from_bytes(data[:4], "big") :])
    return None


def _dates_in(f: BinaryIO) -> dict[int, str]:
    """By what the file's first bytes say it is: TIFF and raw formats built on it, JPEG, PNG, WebP, HEIC and AVIF."""
    start = _at(f, 0, 12)
    exif: BinaryIO | None = None
    if start[:2] in (b"II", b"MM"):
        exif = f
    elif start[:2] == b"\xff\xd8":
        exif = _jpeg_exif(f)
    elif start[:8] == b"\x89PNG\r\n\x1a\n":
        exif = _chunk_exif(f, 8, b"eXIf", True, ">I", 4)
    elif start[:4] == b"RIFF" and start[8:] == b"WEBP":
        exif = _chunk_exif(f, 12, b"EXIF", False, "<I", 0)
    elif start[4:8] == b"ftyp":
        exif = _heif_exif(f)
    return {} if exif is None else _tiff_dates(exif)


def exif_dates(data: bytes) -> dict[int, str]:
    """Date tags of an image, by tag; empty if there are none."""
    try:
        return _dates_in(io.BytesIO(data))
    except struct.error:
        return {}


def _exif_of(path: str) -> dict[int, str]:
    try:
        with open(path, "rb") as f:
            return _dates_in(f)
    except (OSError, struct.error):
        return {}


def with_exif_dates(files: DataFrame, path: str = "path") -> DataFrame:
    """Add ``exif_raw``: the image's own date, else the original's, else the digitised one's."""

    @F.pandas_udf(StringType())
    def raw(paths: pd.Series) -> pd.Series:
        def first(p: str | None) -> str | None:
            tags = {} if p is None else _exif_of(p)
            return next((tags[t] for t in (IMAGE_DATE, ORIGINAL_DATE, DIGITISED_DATE) if t in tags), None)

        return paths.map(first)

    return files.withColumn("exif_raw", raw(F.col(path)))
