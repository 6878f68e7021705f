"""The manifest: what to copy, move or link, and where, as a table. Making it touches no file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.paths import basename, join_path
from lumenfold.operators.albums import album_names, media_order
from lumenfold.options import JSON, NOTHING, SHORTCUT, Options
from lumenfold.plans.naming import assign_names

MAIN_FOLDER, UNDATED_FOLDER = "ALL_PHOTOS", "date-unknown"
#: White space that is trimmed from album names, Unicode included.
_SPACE = r"[\s\u0085   -     　﻿]+"


def destination_folder(output: Column, album: Column, date: Column, divide_to_dates: bool) -> Column:
    """output / album or ALL_PHOTOS / date-unknown, year/month, or nothing."""
    home = F.coalesce(F.regexp_replace(album, rf"^{_SPACE}|{_SPACE}\z", ""), F.lit(MAIN_FOLDER))
    months = F.concat(F.year(date).cast("string"), F.lit("/"), F.lpad(F.month(date).cast("string"), 2, "0"))
    sub = F.when(date.isNull(), F.lit(UNDATED_FOLDER)).otherwise(months if divide_to_dates else F.lit(""))
    return join_path(output, home, sub)


def output_entries(merged: DataFrame, mode: str) -> DataFrame:
    """One row per file that a mode puts out: media_order, album, path, size, date_taken, albums, has_main."""
    has_main = F.exists("files", lambda f: f["album"].isNull())
    rows = merged.select(media_order().alias("media_order"), "files", "size", "date_taken", album_names(F.col("files")).alias("albums"), has_main.alias("has_main"))
    if mode == JSON:
        return rows.select("media_order", F.lit(None).cast("string").alias("album"), F.element_at("files", 1)["path"].alias("path"), "size", "date_taken", "albums", F.lit(True).alias("has_main"))
    rows = rows.withColumn("file", F.explode("files")).select("media_order", F.col("file.album").alias("album"), F.col("file.path").alias("path"), "size", "date_taken", "albums", "has_main")
    return rows.filter(F.col("album").isNull()) if mode == NOTHING else rows


def build_manifest(merged: DataFrame, options: Options, occupied: DataFrame | None = None) -> DataFrame:
    """MANIFEST rows. ``occupied`` lists names (folder, name) that exist in the output already.

    Main files are named first, then everything in albums, links and files alike, since links carry
    their main file's final name. An album called ALL_PHOTOS gets what names the main files leave.
    """
    out = F.lit(options.output.rstrip("/") if options.output != "/" else options.output)
    entries = output_entries(merged, options.albums).withColumn("folder", destination_folder(out, F.col("album"), F.col("date_taken"), options.divide_to_dates))
    entries = entries.withColumn("key", F.to_json(F.struct("media_order.group_ord", "album"), {"ignoreNullFields": "false"}))
    main = entries.filter(F.col("album").isNull()).withColumn("name", basename(F.col("path")))
    main_names = assign_names(main, occupied, "key", ["media_order"])
    done = main.join(main_names, "key").withColumn("dest", join_path(F.col("folder"), F.col("final_name")))
    op = F.lit("copy" if options.copy else "move")
    real = done.select(op.alias("op"), F.col("path").alias("src"), "dest", F.lit(None).cast("string").alias("link_target"), F.col("date_taken").alias("mtime"), "size", "media_order", "album", "albums")
    if options.albums in (JSON, NOTHING):
        return real
    links = options.albums == SHORTCUT
    targets = done.select("media_order", F.col("dest").alias("target"), F.col("final_name").alias("target_name"))
    others = entries.filter(F.col("album").isNotNull()).join(targets, "media_order", "left")
    is_link = F.col("target").isNotNull() & F.lit(links)
    others = others.withColumn("name", F.when(is_link, F.col("target_name")).otherwise(basename(F.col("path"))))
    taken = done.select("folder", F.col("final_name").alias("name"))
    taken = taken if occupied is None else taken.unionByName(occupied.select("folder", "name"))
    names = assign_names(others, taken, "key", ["media_order", "album"])
    placed = others.join(names, "key").select(
        F.when(is_link, F.lit("link")).otherwise(op).alias("op"),
        F.col("path").alias("src"),
        join_path(F.col("folder"), F.col("final_name")).alias("dest"),
        F.when(is_link, F.col("target")).alias("link_target"),
        F.col("date_taken").alias("mtime"),
        "size",
        "media_order",
        "album",
        "albums",
    )
    return real.unionByName(placed)


def albums_index(manifest: DataFrame) -> DataFrame:
    """(name, albums) of main files: basename to album names; of equal basenames the last counts."""
    main = manifest.filter(F.col("album").isNull())
    return main.groupBy(basename(F.col("dest")).alias("name")).agg(F.max_by("albums", "media_order").alias("albums"))
