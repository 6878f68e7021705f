"""The whole run: scan, classify, remove duplicates and extras, date, merge, plan; and fix mode.

The order has meaning: duplicates go before dates are known, so only name lengths decide between
them; albums merge after, so that an album's sidecar can date the copy in a year folder.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators.albums import merge_albums
from lumenfold.operators.classify import fix_list, media_list
from lumenfold.operators.content import with_content_key
from lumenfold.operators.dates import extractors, resolve_dates
from lumenfold.operators.dedup import remove_duplicates
from lumenfold.operators.extras import remove_extras
from lumenfold.options import Options
from lumenfold.plans.execute import execute, prepare_output, set_times, write_albums_index
from lumenfold.plans.manifest import build_manifest
from lumenfold.sources.filesystem import fs_entries
from lumenfold.staging import staged


class NothingFound(Exception):
    """No media in the input."""


@dataclass
class Plan:
    """Frames of one run; ``summary`` has duplicates, extras, undated and files put out.

    ``outcomes`` is there after a run that wasn't dry. The frames stand on staged tables, which
    ``lumenfold.staging.release`` deletes.
    """

    media: DataFrame
    merged: DataFrame
    manifest: DataFrame
    summary: DataFrame
    outcomes: DataFrame | None = None

    def undated_paths(self) -> DataFrame:
        """(path) of the files without a date, one a record."""
        return self.merged.filter(F.col("date_taken").isNull()).select(F.element_at("files", 1)["path"].alias("path"))


def plan(spark: SparkSession, options: Options, entries: DataFrame | None = None, occupied: DataFrame | None = None) -> Plan:
    spark.conf.set("spark.sql.session.timeZone", options.timezone)
    entries = staged(fs_entries(spark, options.input) if entries is None else entries)
    # list order and digests are used by several stages: computed once
    media = staged(with_content_key(staged(media_list(entries)), oversize_policy=options.oversize_policy))
    unique = remove_duplicates(media)
    kept = remove_extras(unique, options.extra_suffixes) if options.skip_extras else unique
    kept = staged(kept)
    merged = staged(merge_albums(resolve_dates(kept, entries, extractors(options))))
    manifest = build_manifest(merged, options, occupied)
    return Plan(media, merged, manifest, summary(media, unique, kept, merged))


def summary(media: DataFrame, unique: DataFrame, kept: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: what each stage left out, and what has no date. Stages are counted in one aggregate."""
    no = F.lit(False)
    rows = None
    for stage, df in enumerate((media, unique, kept, merged)):
        part = df.select(F.lit(stage).alias("stage"), (F.col("date_taken").isNull() if df is merged else no).alias("bare"))
        rows = part if rows is None else rows.unionByName(part)
    n = [F.count_if(F.col("stage") == k) for k in range(4)]
    return rows.agg((n[0] - n[1]).alias("duplicates"), (n[1] - n[2]).alias("extras"), n[3].alias("media"), F.count_if("bare").alias("undated"))


def organise(spark: SparkSession, options: Options, dry_run: bool = True) -> Plan:
    """Plan a run and, unless ``dry_run``, perform it."""
    if not dry_run:
        prepare_output(options.output, options.input, options.on_nonempty_output)
    occupied = None
    if options.on_nonempty_output == "append":
        there = fs_entries(spark, options.output)
        occupied = there.select(F.col("parent").alias("folder"), "name")
    made = plan(spark, options, occupied=occupied)
    if made.media.isEmpty():
        raise NothingFound(options.input)
    if not dry_run:
        made.manifest = staged(made.manifest)  # before files move
        made.outcomes = execute(made.manifest, instead="copy" if options.copy else "move")
        if options.albums == "json":
            write_albums_index(made.manifest, options.output)
    return made


def fix(spark: SparkSession, folder: str, options: Options | None = None) -> DataFrame:
    """Set the modification time of every datable file below a folder: one row (set, not_set)."""
    options = options or Options()
    spark.conf.set("spark.sql.session.timeZone", options.timezone)
    entries = staged(fs_entries(spark, folder))
    dated = resolve_dates(staged(fix_list(entries)), entries, extractors(options))
    return set_times(dated).agg(F.count_if("done").alias("set"), F.count_if(~F.col("done")).alias("not_set"))
