"""Directory trees as a table: a Python data source that lists every entry below a root.

Spark's own file source leaves out empty files, hidden names and folders; all of these count here.
Each folder directly below the root is a partition of its own, so listings run in parallel; the
root must be mounted alike on all executors. ``entries_in_store`` lists a store that only Spark
reads, with its reader's omissions.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumenfold.functions.paths import basename, dirname
from lumenfold.schemas import FS_ENTRIES


class Subtree(InputPartition):
    def __init__(self, folder: str, deep: bool):
        super().__init__((folder, deep))
        self.folder, self.deep = folder, deep


def _row(path: str, is_dir: bool) -> tuple:
    try:
        info = os.stat(path)
        length, mtime = (0 if is_dir else info.st_size), datetime.fromtimestamp(info.st_mtime, timezone.utc)
    except OSError:  # a dangling link, or gone meanwhile
        length, mtime = None, None
    return path, os.path.dirname(path), os.path.basename(path), is_dir, length, mtime


def walk(folder: str, deep: bool) -> Iterator[tuple]:
    """Entries below ``folder``, links followed, each real folder once."""
    waiting, known = [folder], {os.path.realpath(folder)}
    while waiting:
        here = waiting.pop()
        with os.scandir(here) as entries:
            for e in entries:
                is_dir = e.is_dir()
                yield _row(e.path, is_dir)
                if deep and is_dir and (real := os.path.realpath(e.path)) not in known:
                    known.add(real)
                    waiting.append(e.path)


class _Reader(DataSourceReader):
    def __init__(self, root: str, recursive: bool):
        self.root, self.recursive = root, recursive

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = [Subtree(self.root, False)]
        if self.recursive:
            with os.scandir(self.root) as entries:
                found += [Subtree(e.path, True) for e in entries if e.is_dir()]
        return found

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        assert isinstance(partition, Subtree)
        yield from walk(partition.folder, partition.deep)


class FsEntries(DataSource):
    """``spark.read.format("fs_entries").option("recursive", "true").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "fs_entries"

    def schema(self) -> str:
        return FS_ENTRIES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(os.path.abspath(self.options["path"]), self.options.get("recursive", "true") == "true")


def fs_entries(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    spark.dataSource.register(FsEntries)
    return spark.read.format("fs_entries").option("recursive", str(recursive).lower()).load(root)


def entries_in_store(spark: SparkSession, root: str) -> DataFrame:
    """Files below a root that only Spark reads, and their folders; no empty folders or hidden names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length"), F.col("modificationTime").alias("mtime"))
    rows = files.select("path", dirname(F.col("path")).alias("parent"), basename(F.col("path")).alias("name"), F.lit(False).alias("is_dir"), "length", "mtime")
    folders = rows.select(F.col("parent").alias("path")).distinct().select("path", dirname(F.col("path")).alias("parent"), basename(F.col("path")).alias("name"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("mtime"))
    return rows.unionByName(folders)
