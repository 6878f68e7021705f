"""Free names: ``(1)`` is added before the extension until a name is free in its folder.

Names that can meet share their stem without trailing ``(1)``s; so (folder, that root) is a group
of its own, small even in a folder that holds everything. In a group a name is a level, the number
of ``(1)``s, and each entry in turn takes the first free level from its own up. A group's rows pass
one task one after another, in time and memory in proportion to their number; only the names
themselves, which grow by three characters a level, are written in full at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.paths import extension, stem

_TAIL = r"(?:\(1\))+\z"


def root_of(name: Column) -> Column:
    """(stem without trailing ``(1)``s, extension)."""
    return F.struct(F.regexp_replace(stem(name), _TAIL, "").alias("stem"), extension(name).alias("ext"))


def level_of(name: Column) -> Column:
    s = stem(name)
    return ((F.length(s) - F.length(F.regexp_replace(s, _TAIL, ""))) / 3).cast("int")


def named(root: Column, level: Column) -> Column:
    return F.concat(root["stem"], F.repeat(F.lit("(1)"), level), root["ext"])


def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels of rows sorted by group, taken names before entries, entries by turn; only entries come out.

    ``after`` leads from each level that isn't free to a later one. Ways are shortened as they are
    walked, so an entry takes nearly constant time, however many names its group has.
    """
    group, after = None, {}
    for b in batches:
        out: list[int | None] = []
        for *here, level, is_new in zip(*(b.column(n).to_pylist() for n in ("folder", "stem", "ext", "level", "is_new"))):
            if here != group:
                group, after = here, {}
            free = level
            while free in after:
                free = after[free]
            step = level
            while step != free:
                after[step], step = free, after[step]
            out.append(free)
            if level is not None and (is_new or free == level):
                after[free] = free + 1
        placed = pa.RecordBatch.from_arrays([b.column("key"), b.column("stem"), b.column("ext"), pa.array(out, pa.int32())], ["key", "stem", "ext", "level"])
        yield placed.filter(b.column("is_new"))


def assign_names(entries: DataFrame, occupied: DataFrame | None, key: str, order: list[str]) -> DataFrame:
    """(key, final_name) for rows (key, folder, name, *order); ``occupied`` lists taken (folder, name)."""
    name = F.col("name")
    group = ["folder", "stem", "ext"]
    columns = [F.col("folder"), root_of(name)["stem"].alias("stem"), root_of(name)["ext"].alias("ext"), level_of(name).alias("level")]
    rows = entries.select(*columns, F.lit(True).alias("is_new"), F.col(key).cast("string").alias("key"), F.struct(F.struct(*order), key, level_of(name)).alias("turn"))
    if occupied is not None:
        rows = rows.unionByName(occupied.select(*columns, F.lit(False).alias("is_new")).distinct(), allowMissingColumns=True)
    # dealt by a hash of the group, as the planner may take a shuffle by the group itself for done
    sorted_rows = rows.repartition(F.xxhash64(*group)).sortWithinPartitions(*group, "is_new", "turn").drop("turn")
    placed = sorted_rows.mapInArrow(place, "key string, stem string, ext string, level int")
    return placed.select(F.col("key").alias(key), named(F.struct("stem", "ext"), F.col("level")).alias("final_name"))
