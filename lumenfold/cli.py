"""Command line. Exit codes: 0 done, 1 copy or move failed, 2 bad arguments, 10 input or output missing, 11 no such folder, 12 output not empty, 13 no media."""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumenfold.options import ALBUM_MODES, SHORTCUT, Options
from lumenfold.plans.execute import OutputNotEmpty
from lumenfold.plans.organise import NothingFound, fix, organise
from lumenfold.staging import release

OK, FAILED, MISSING, NO_FOLDER, NOT_EMPTY, NO_MEDIA = 0, 1, 10, 11, 12, 13


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenfold", description=__doc__)
    p.add_argument("--fix", metavar="DIR", help="only set file times below a folder")
    p.add_argument("--input", "-i")
    p.add_argument("--output", "-o")
    p.add_argument("--albums", choices=ALBUM_MODES, default=SHORTCUT)
    p.add_argument("--divide-to-dates", action="store_true")
    p.add_argument("--skip-extras", action="store_true")
    p.add_argument("--guess-from-name", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--copy", action="store_true")
    p.add_argument("--on-nonempty-output", choices=("fail", "clean", "append"), default="fail")
    p.add_argument("--timezone", default="UTC")
    p.add_argument("--dry-run", action="store_true", help="print the summary, touch no file")
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.fix is None and not (args.input and args.output):
        print("--input and --output are required", file=sys.stderr)
        return MISSING
    folder = args.fix if args.fix is not None else args.input
    if not os.path.isdir(folder):
        print(f"no such folder: {folder}", file=sys.stderr)
        return NO_FOLDER
    options = Options(args.input or "", args.output or "", args.albums, args.divide_to_dates, args.skip_extras, args.guess_from_name, args.copy, args.timezone, on_nonempty_output=args.on_nonempty_output)
    spark = spark or SparkSession.builder.appName("lumenfold").config("spark.speculation", "false").getOrCreate()
    try:
        if args.fix is not None:
            r = fix(spark, folder, options).first()
            print(f"times set: {r['set']}, not set: {r['not_set']}")
            return OK
        made = organise(spark, options, args.dry_run)
        for r in made.undated_paths().toLocalIterator():
            print(f"no date: {r['path']}")
        r = made.summary.first()
        print(f"duplicates skipped: {r['duplicates']}, extras skipped: {r['extras']}, without a date: {r['undated']}")
        if made.outcomes is not None:
            done = {x["op"]: x["n"] for x in made.outcomes.groupBy("op").agg(F.count("*").alias("n")).collect()}
            print("put out: " + ", ".join(f"{done.get(op, 0)} {op}" for op in ("copy", "move", "link")))
            for r in made.outcomes.filter(F.col("warning").isNotNull()).toLocalIterator():
                print(f"warning: {r['dest']}: {r['warning']}", file=sys.stderr)
        return OK
    except NothingFound:
        print("no photos or videos in year or album folders", file=sys.stderr)
        return NO_MEDIA
    except OutputNotEmpty:
        print("the output folder isn't empty", file=sys.stderr)
        return NOT_EMPTY
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return FAILED
    finally:
        release(spark)


if __name__ == "__main__":
    sys.exit(main())
