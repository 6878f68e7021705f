"""Execution of a manifest: the only module that writes to the file system.

Tasks may run twice, so every action is idempotent: a destination that is already right is left
alone, and one that holds anything else fails the run. Turn speculation off. Links come after real
files; where a link can't be made, the album's own file takes its place. Tasks are balanced by the
bytes that they copy and the files that they touch. Each action's outcome is a row.
"""

from __future__ import annotations

import errno
import filecmp
import json
import os
import shutil
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.plans.manifest import albums_index
from lumenfold.sources.content import spread_by_bytes
from lumenfold.staging import staged

OUTCOME = "op string, dest string, done boolean, warning string"


class OutputNotEmpty(Exception):
    pass


def _copy(src: str, dest: str) -> None:
    if os.path.lexists(dest):
        if filecmp.cmp(src, dest, shallow=False):
            return  # an earlier attempt copied it
        raise FileExistsError(errno.EEXIST, "came up after the plan", dest)
    part = f"{dest}.part-{os.getpid()}"
    shutil.copyfile(src, part)
    os.replace(part, dest)


def _move(src: str, dest: str) -> None:
    if not os.path.lexists(src) and os.path.lexists(dest):
        return  # an earlier attempt moved it
    if os.path.lexists(dest) and not (os.path.isfile(src) and os.path.isfile(dest) and filecmp.cmp(src, dest, shallow=False)):
        raise FileExistsError(errno.EEXIST, "came up after the plan", dest)
    try:
        os.rename(src, dest)
    except OSError as e:
        if e.errno != errno.EXDEV:
            raise
        _copy(src, dest)  # another drive
        os.remove(src)


def _link(target: str, dest: str) -> None:
    wanted = os.path.relpath(target, os.path.dirname(dest))
    if not (os.path.islink(dest) and os.readlink(dest) == wanted):
        os.symlink(wanted, dest)


def _put(op: str, src: str, dest: str, link_target: str | None, instead: str) -> tuple[str, str | None]:
    """What was done, and a warning if that isn't what was planned."""
    os.makedirs(os.path.dirname(dest), exist_ok=True)
    warning = None
    if op == "link":
        try:
            _link(link_target or "", dest)
            return op, None
        except FileExistsError:
            raise
        except OSError as e:
            op, warning = instead, f"no link: {e}"
    (_copy if op == "copy" else _move)(src, dest)
    return op, warning


def _touch(dest: str, seconds: float, follow: bool) -> str | None:
    try:
        os.utime(dest, (seconds, seconds), follow_symlinks=follow)
    except (OSError, OverflowError, ValueError) as e:
        return f"modification time not set: {e}"
    return None


def _perform(now: float, instead: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[dict[str, Any]] = []
            for r in b.to_pylist():
                op, warning = _put(r["op"], r["src"], r["dest"], r["link_target"], instead)
                late = _touch(r["dest"], now if r["seconds"] is None else r["seconds"], op != "link")
                out.append({"op": op, "dest": r["dest"], "done": True, "warning": "; ".join(filter(None, (warning, late))) or None})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("op", pa.string()), ("dest", pa.string()), ("done", pa.bool_()), ("warning", pa.string())]))

    return run


def _seconds(date: str) -> Column:
    return (F.unix_micros(F.col(date).cast("timestamp")) / 1_000_000).alias("seconds")


def execute(manifest: DataFrame, now: datetime | None = None, instead: str = "move") -> DataFrame:
    """Perform a written manifest; returns outcomes. Undated files get ``now``, one moment per run.

    A failing copy or move fails the run. ``instead`` is done with an album's own file where a link
    can't be made, with a warning in its outcome.
    """
    moment = (now or datetime.now(timezone.utc)).timestamp()
    rows = manifest.select("op", "src", "dest", "link_target", _seconds("mtime"), "size")
    parts = []
    for wanted in (F.col("op") != "link", F.col("op") == "link"):
        dealt = spread_by_bytes(staged(rows.filter(wanted)), F.when(F.col("op") == "copy", F.col("size")).otherwise(0), "dest")
        parts.append(staged(dealt.drop("size").mapInArrow(_perform(moment, instead), OUTCOME)))
    return parts[0].unionByName(parts[1])


def set_times(dated: DataFrame) -> DataFrame:
    """Fix mode: set the times of (path, date_taken) in place; undated files stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [{"path": r["path"], "done": r["seconds"] is not None and _touch(r["path"], r["seconds"], True) is None} for r in b.to_pylist()]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("done", pa.bool_())]))

    rows = spread_by_bytes(staged(dated.select("path", _seconds("date_taken"))), F.lit(0))
    return rows.mapInArrow(run, "path string, done boolean")


def write_albums_index(manifest: DataFrame, output: str) -> str:
    """``albums-info.json``: one JSON object, written entry by entry as partitions arrive."""
    path = os.path.join(output, "albums-info.json")
    os.makedirs(output, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("{")
        for k, r in enumerate(albums_index(manifest).toLocalIterator()):
            f.write(("," if k else "") + json.dumps(r["name"], ensure_ascii=False) + ":" + json.dumps(list(r["albums"]), ensure_ascii=False, separators=(",", ":")))
        f.write("}")
    return path


def prepare_output(output: str, inputs: str, policy: str) -> None:
    """Create the output folder; deal with what is in it, the input folder excepted."""
    os.makedirs(output, exist_ok=True)
    there = [e.path for e in os.scandir(output) if os.path.abspath(e.path) != os.path.abspath(inputs)]
    if there and policy == "fail":
        raise OutputNotEmpty(output)
    if policy == "clean":
        for p in there:
            shutil.rmtree(p) if os.path.isdir(p) and not os.path.islink(p) else os.remove(p)


def free_bytes(path: str) -> int | None:
    try:
        return shutil.disk_usage(path).free
    except OSError:
        return None
