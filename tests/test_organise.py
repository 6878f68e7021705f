"""Whole runs over real folders, fix mode and the command line."""

from __future__ import annotations

import datetime as dt
import json
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from lumenfold import cli, staging
from lumenfold.operators.content import with_content_key
from lumenfold.operators.dedup import remove_duplicates
from lumenfold.options import Options
from lumenfold.plans import execute as execution
from lumenfold.plans.execute import free_bytes
from lumenfold.plans.organise import NothingFound, fix, organise, plan
from lumenfold.sources import content as source_content
from lumenfold.sources.content import exif_dates, spread_by_bytes, with_exif_dates
from lumenfold.sources.filesystem import entries_in_store, fs_entries


def jpeg(date: str) -> bytes:
    """A JPEG header whose EXIF has DateTimeOriginal."""
    text = date.encode() + b"\0"
    sub = struct.pack(">HHHII", 1, 0x9003, 2, len(text), 44) + struct.pack(">I", 0)
    tiff = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">HHHII", 1, 0x8769, 4, 1, 26) + struct.pack(">I", 0) + sub + text
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"


#: Names, their sidecars' names and epochs, as exports have them; by folder, with contents of our own.
YEAR, OLDER, ALBUM = "Photos from 2020", "Photos from 2015", "Summer at sea"
SIDECARS = {
    YEAR: {
        "image-edited.jpg.json": 1599078832,
        "Urlaub in Knaufspesch in der Schneifel (38).JP.json": 1683078832,
        "Screenshot_2022-10-28-09-31-43-118_com.snapcha.json": 1666942303,
        "simple_file_20200101.jpg.json": 1683074444,
        "img_(87).(vacation stuff).lol.jpg(87).json": 1680289442,
    },
    OLDER: {"IMG-20150125-WA0003.jpg.json": 1422183600},
}
FILES = {
    YEAR: {
        "image-edited.jpg": b"a picture in two places",
        "Urlaub in Knaufspesch in der Schneifel (38).JPG": b"a long name",
        "Screenshot_2022-10-28-09-31-43-118_com.snapchat.jpg": b"a screen",
        "simple_file_20200101-edited.jpg": b"one of a pair",
        "simple_file_20200101-edited(1).jpg": b"one of a pair",
        "img_(87).(vacation stuff).lol(87).jpg": b"brackets",
        "green.jpg": jpeg("2022:12:16 16:06:47"),
        "notes.txt": b"no picture",
    },
    OLDER: {"IMG-20150125-WA0003-modifié.jpg": b"edited", "IMG-20150125-WA0003-modifié(1).jpg": b"edited again"},
    ALBUM: {"image-edited.jpg": b"a picture in two places"},
}


@pytest.fixture
def tree(tmp_path):
    home = tmp_path / "in/export"
    for folder, files in FILES.items():
        (home / folder).mkdir(parents=True)
        for name, data in files.items():
            (home / folder / name).write_bytes(data)
        for name, epoch in SIDECARS.get(folder, {}).items():
            (home / folder / name).write_text(json.dumps({"photoTakenTime": {"timestamp": str(epoch)}}))
    (home / ".hidden").mkdir()
    return tmp_path


def listing(folder):
    return {os.path.relpath(os.path.join(d, f), folder): os.path.islink(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files}


def test_dates_of_a_tree(spark, tree):
    made = plan(spark, Options(input=str(tree / "in"), output=str(tree / "out")))
    got = {f.path.rpartition("/")[2]: (int(r.date_taken.timestamp()) if r.date_taken else None, r.accuracy) for r in made.merged.collect() for f in r.files[:1]}
    assert got["image-edited.jpg"] == (1599078832, 0)
    assert got["Urlaub in Knaufspesch in der Schneifel (38).JPG"] == (1683078832, 0)
    assert got["Screenshot_2022-10-28-09-31-43-118_com.snapchat.jpg"] == (1666942303, 0)
    assert got["img_(87).(vacation stuff).lol(87).jpg"] == (1680289442, 0)
    assert got["IMG-20150125-WA0003-modifié.jpg"] == (1422183600, 0)
    assert got["IMG-20150125-WA0003-modifié(1).jpg"] == (1422183600, 3)
    assert got["green.jpg"] == (1671206807, 1)
    row = made.summary.first()
    assert (row.duplicates, row.extras, row.media, row.undated) == (1, 0, 8, 0)


def test_hard_search_ranks_lower_without_guessing(spark, tree):
    made = plan(spark, Options(input=str(tree / "in"), output=str(tree / "out"), guess_from_name=False))
    ranks = {r.files[0].path.rpartition("/")[2]: r.accuracy for r in made.merged.collect()}
    assert ranks["IMG-20150125-WA0003-modifié(1).jpg"] == 2


@pytest.mark.parametrize(("mode", "files", "links"), [("shortcut", 8, 1), ("nothing", 8, 0), ("duplicate-copy", 9, 0), ("json", 9, 0)])
def test_modes(spark, tree, mode, files, links):
    out = tree / "out"
    organise(spark, Options(input=str(tree / "in"), output=str(out), albums=mode, copy=True), dry_run=False)
    got = listing(out)
    assert sum(not x for x in got.values()) == files and sum(got.values()) == links
    assert os.path.getmtime(out / "ALL_PHOTOS/image-edited.jpg") == 1599078832
    assert (tree / "in/export/Photos from 2020/image-edited.jpg").exists()
    if mode == "shortcut":
        assert os.readlink(out / ALBUM / "image-edited.jpg") == "../ALL_PHOTOS/image-edited.jpg"
    if mode == "json":
        index = json.loads((out / "albums-info.json").read_text())
        assert index["image-edited.jpg"] == [ALBUM] and index["green.jpg"] == [] and len(index) == 8


def test_move_skip_extras_and_divide(spark, tree):
    out = tree / "out"
    organise(spark, Options(input=str(tree / "in"), output=str(out), skip_extras=True, divide_to_dates=True), dry_run=False)
    got = listing(out)
    assert "ALL_PHOTOS/2022/12/green.jpg" in got and not any("image-edited" in x for x in got)
    assert not (tree / "in/export/Photos from 2020/green.jpg").exists()


def test_append_renames(spark, tree):
    out = tree / "out"
    (out / "ALL_PHOTOS").mkdir(parents=True)
    (out / "ALL_PHOTOS/green.jpg").write_bytes(b"old")
    organise(spark, Options(input=str(tree / "in"), output=str(out), copy=True, on_nonempty_output="append"), dry_run=False)
    assert (out / "ALL_PHOTOS/green.jpg").read_bytes() == b"old" and (out / "ALL_PHOTOS/green(1).jpg").exists()


def test_dry_run_touches_nothing(spark, tree):
    organise(spark, Options(input=str(tree / "in"), output=str(tree / "out")))
    assert not (tree / "out").exists()


def test_fix(spark, tree):
    assert tuple(fix(spark, str(tree / "in")).first()) == (9, 1)
    assert os.path.getmtime(tree / "in/export/Photos from 2020/green.jpg") == 1671206807


def test_sidecar_is_chosen_by_existence(spark, tmp_path):
    year = tmp_path / "Photos from 2020"
    year.mkdir()
    (year / "a-edited.jpg").write_bytes(b"1")
    (year / "a-edited.jpg.json").write_text("{broken")
    (year / "a.jpg.json").write_text('{"photoTakenTime": {"timestamp": "5"}}')
    (year / "b.jpg").write_bytes(b"22")
    (year / "b.jpg.json").write_bytes(b"\xff\xfe\x00")
    made = plan(spark, Options(input=str(tmp_path), output="/out"))
    assert [r.date_taken for r in made.merged.collect()] == [None, None]
    assert made.summary.first().undated == 2


def test_scan_sees_everything(spark, tmp_path):
    for d in ("a/empty", "b"):
        (tmp_path / d).mkdir(parents=True)
    for n in ("_x.jpg", ".x.jpg", "zero.jpg", "a b%20#.jpg"):
        (tmp_path / "b" / n).write_bytes(b"" if n == "zero.jpg" else b"1")
    os.symlink(tmp_path / "b", tmp_path / "a/link")
    os.symlink(tmp_path, tmp_path / "b/loop")
    names = [r.name for r in fs_entries(spark, str(tmp_path)).collect()]
    assert {"empty", "_x.jpg", ".x.jpg", "zero.jpg", "a b%20#.jpg", "link", "loop"} <= set(names)
    assert len(names) < 60
    flat = fs_entries(spark, str(tmp_path), recursive=False).collect()
    assert sorted(r.name for r in flat) == ["a", "b"]


def test_store_listing(spark, tmp_path):
    (tmp_path / "b").mkdir()
    for n in ("_x.jpg", "a b%20#.jpg"):
        (tmp_path / "b" / n).write_bytes(b"1")
    got = {r.name: r.is_dir for r in entries_in_store(spark, str(tmp_path)).collect()}
    assert got == {"a b%20#.jpg": False, "b": True}


def tiff(date: str, order: str = "<") -> bytes:
    text = date.encode() + b"\0"
    mark = b"II*\0" if order == "<" else b"MM\0*"
    return mark + struct.pack(f"{order}IHHHIII", 8, 1, 0x0132, 2, len(text), 26, 0) + text


def box(kind: bytes, *bodies: bytes) -> bytes:
    body = b"".join(bodies)
    return struct.pack(">I", 8 + len(body)) + kind + body


def heic(date: str, version: int = 1, inside: bool = False) -> bytes:
    """A picture item and an Exif item, which stands in the file or in the idat box."""
    exif = struct.pack(">I", 6) + b"Exif\0\0" + tiff(date)
    names = b"".join(box(b"infe", b"\2\0\0\0", struct.pack(">HH", k, 0), kind, b"\0") for k, kind in ((1, b"hvc1"), (2, b"Exif")))
    where = lambda method, at: struct.pack(">H", 2) + (struct.pack(">H", method) if version else b"") + struct.pack(">HHII", 0, 1, at, len(exif))
    other = struct.pack(">H", 1) + (b"\0\0" if version else b"") + struct.pack(">HHII", 0, 1, 0, 4)

    def made(at: int) -> bytes:
        iloc = box(b"iloc", bytes([version, 0, 0, 0]), b"\x44\0", struct.pack(">H", 2), other, where(int(inside), at))
        meta = box(b"meta", b"\0\0\0\0", box(b"hdlr", b"\0" * 20), box(b"iinf", b"\0\0\0\0", struct.pack(">H", 2), names), iloc, *([box(b"idat", b"12345", exif)] if inside else []))
        return box(b"ftyp", b"heic\0\0\0\0mif1") + meta + box(b"mdat", b"\0" * 9, exif)

    return made(5) if inside else made(len(made(0)) - len(exif))


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + b"\0" * 4


DATE = "2021:02:03 04:05:06"
IMAGES = {
    "le.tif": tiff(DATE),
    "be.tif": tiff(DATE, ">"),
    "a.jpg": jpeg(DATE),
    "a.png": b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", b"\0" * 13) + chunk(b"IDAT", b"\0" * 300_000) + chunk(b"eXIf", tiff(DATE)) + chunk(b"IEND", b""),
    "a.webp": b"RIFF\0\0\0\0WEBP" + b"VP8 " + struct.pack("<I", 3) + b"abc\0" + b"EXIF" + struct.pack("<I", len(tiff(DATE)) + 6) + b"Exif\0\0" + tiff(DATE),
    "a.heic": heic(DATE),
    "b.heic": heic(DATE, version=0),
    "c.heic": heic(DATE, inside=True),
}


def test_exif_of_every_format(spark, tmp_path):
    for name, data in IMAGES.items():
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([(str(tmp_path / n), n) for n in [*IMAGES, "nowhere.jpg"]], "path string, name string")
    got = {r.name: r.exif_raw for r in with_exif_dates(files).collect()}
    assert got == {**dict.fromkeys(IMAGES, DATE), "nowhere.jpg": None}


@pytest.mark.parametrize("name", IMAGES)
def test_exif_of_cut_off_and_scrambled_images(name):
    data = IMAGES[name]
    for stop in [*range(0, min(len(data), 400)), len(data) - 1]:
        assert set(exif_dates(data[:stop]).values()) <= {DATE, *(DATE[:k] for k in range(len(DATE)))}
    rng = random.Random(name)
    for _ in range(300):
        bad = bytearray(data[:600])
        for _ in range(3):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        exif_dates(bytes(bad))


def test_file_tasks_follow_bytes_and_files(spark, monkeypatch):
    files = spark.createDataFrame([(f"/f{k}", 10) for k in range(1000)], "path string, size long").coalesce(1)
    tasks = lambda: spread_by_bytes(files, F.col("size")).rdd.getNumPartitions()
    assert tasks() == 1
    monkeypatch.setattr(source_content, "TASK_FILES", 100)
    assert tasks() == 10
    monkeypatch.setattr(source_content, "TASK_BYTES", 500)
    assert tasks() == 20
    sizes = [r["count"] for r in spread_by_bytes(files, F.col("size")).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 90


def test_unreadable_files_equal_no_other(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"same")
    (tmp_path / "b.jpg").write_bytes(b"same")
    rows = [(k, str(tmp_path / n), n, size) for k, (n, size) in enumerate([("a.jpg", 4), ("b.jpg", 4), *((f"gone{k}.jpg", 4) for k in range(5)), ("x.jpg", None), ("y.jpg", None)])]
    media = with_content_key(spark.createDataFrame(rows, "ord long, path string, name string, size long")).withColumn("album", F.lit(None).cast("string"))
    assert remove_duplicates(media).count() == 8


def test_a_link_that_cant_be_made_becomes_the_albums_own_file(spark, tmp_path, monkeypatch):
    for n in ("main.jpg", "album.jpg"):
        (tmp_path / n).write_bytes(b"same")
    blocked = tmp_path / "out/no\0links"
    rows = [("link", str(tmp_path / "album.jpg"), str(tmp_path / "out/A/main.jpg"), f"{blocked}/main.jpg", None, 4), ("copy", str(tmp_path / "main.jpg"), str(tmp_path / "out/main.jpg"), None, dt.datetime(2020, 1, 1), 4)]
    manifest = spark.createDataFrame(rows, "op string, src string, dest string, link_target string, mtime timestamp, size long")

    def refuse(target, dest):
        raise OSError(1, "links aren't allowed here")

    monkeypatch.setattr(execution, "_link", refuse)
    assert execution._put("link", *rows[0][1:4], "copy")[0] == "copy"
    assert (tmp_path / "out/A/main.jpg").read_bytes() == b"same" and (tmp_path / "album.jpg").exists()
    op, warning = execution._put("link", rows[0][1], str(tmp_path / "out/B/main.jpg"), rows[0][3], "move")
    assert op == "move" and "links aren't allowed" in warning and not (tmp_path / "album.jpg").exists()
    done = execution.execute(manifest.filter("op = 'copy'")).collect()
    assert [(r.op, r.warning) for r in done] == [("copy", None)] and os.path.getmtime(tmp_path / "out/main.jpg") == 1577836800


def test_what_came_up_after_the_plan_isnt_overwritten(tmp_path):
    for n, data in (("a", b"one"), ("b", b"two"), ("c", b"one")):
        (tmp_path / n).write_bytes(data)
    a, b, c = (str(tmp_path / n) for n in "abc")
    for op in ("copy", "move"):
        with pytest.raises(FileExistsError):
            execution._put(op, a, b, None, "move")
    assert (tmp_path / "b").read_bytes() == b"two"
    assert execution._put("copy", a, c, None, "move") == ("copy", None) and execution._put("move", a, c, None, "move") == ("move", None)
    assert execution._put("move", a, c, None, "move") == ("move", None) and not os.path.exists(a)


def test_dates_that_no_calendar_holds(spark, tmp_path):
    """Sidecars with extreme epochs are undated, whatever they are, and the run goes on."""
    year = tmp_path / "in/Photos from 2020"
    year.mkdir(parents=True)
    epochs = ["9223372036854775807", "-9223372036854775808", "99999999999999999999", "253402300800", "253402300799", "-62135596800", "-62135596801", "0"]
    for k, e in enumerate(epochs):
        (year / f"{k}.jpg").write_bytes(b"x" * (k + 1))
        (year / f"{k}.jpg.json").write_text(json.dumps({"photoTakenTime": {"timestamp": e}}))
    made = organise(spark, Options(input=str(tmp_path / "in"), output=str(tmp_path / "out"), copy=True), dry_run=False)
    dated = {r.files[0].path[-5:-4] for r in made.merged.filter("date_taken IS NOT NULL").select("files").collect()}
    assert dated == {"4", "5", "7"} and len(listing(tmp_path / "out")) == 8
    assert {r.path[-5:-4] for r in made.undated_paths().collect()} == set("01236")


def test_staged_tables_are_deleted(spark, tree):
    staging.release(spark)
    made = plan(spark, Options(input=str(tree / "in"), output=str(tree / "out")))
    tables = list(staging._written)
    assert made.merged.count() and tables and all(os.path.isdir(p.removeprefix("file:")) for p in tables)
    first, *others, last = tables
    staging.release(spark, since=1, keep_last=True)
    assert [p for p in tables if os.path.exists(p.removeprefix("file:"))] == [first, last] == staging._written
    staging.release(spark)
    assert others and not staging._written and not any(os.path.exists(p.removeprefix("file:")) for p in tables)


def test_exif_of_other_data():
    assert exif_dates(b"") == {} and exif_dates(b"\xff\xd8\xff\xd9") == {} and exif_dates(b"\x89PNG") == {}
    assert exif_dates(jpeg("2022:12:16 16:06:47")) == {0x9003: "2022:12:16 16:06:47"}


def test_exif_far_into_the_file(spark, tmp_path):
    date, gap = b"2022:12:16 16:06:47\0", b"\0" * 300_000
    at = 8 + len(gap)
    tiff = b"II*\0" + struct.pack("<I", at) + gap + struct.pack("<HHHIII", 1, 0x0132, 2, len(date), at + 18, 0) + date
    (tmp_path / "late.tif").write_bytes(tiff)
    segments = (b"\xff\xe2" + struct.pack(">H", 65_535) + b"\0" * 65_533) * 5
    late = jpeg("2019:03:07 03:05:06")
    (tmp_path / "late.jpg").write_bytes(late[:2] + segments + late[2:])
    files = spark.createDataFrame([(str(tmp_path / n),) for n in ("late.jpg", "late.tif")], "path string")
    assert [r.exif_raw for r in with_exif_dates(files).orderBy("path").collect()] == ["2019:03:07 03:05:06", "2022:12:16 16:06:47"]


def test_command_line(spark, tree, capsys):
    out = str(tree / "out")
    assert cli.main(["--input", str(tree / "in")], spark) == 10
    assert cli.main(["-i", str(tree / "nowhere"), "-o", out], spark) == 11
    with pytest.raises(SystemExit) as e:
        cli.main(["--albums", "other"], spark)
    assert e.value.code == 2
    (tree / "bare").mkdir()
    assert cli.main(["-i", str(tree / "bare"), "-o", out], spark) == 13
    assert cli.main(["-i", str(tree / "in"), "-o", out, "--copy"], spark) == 0
    said = capsys.readouterr().out
    assert "duplicates skipped: 1" in said and "put out: 8 copy, 0 move, 1 link" in said and "no date" not in said
    assert cli.main(["-i", str(tree / "in"), "-o", out], spark) == 12
    assert cli.main(["--fix", str(tree / "in")], spark) == 0
    with pytest.raises(NothingFound):
        organise(spark, Options(input=str(tree / "bare"), output=out))


def test_free_bytes(tmp_path):
    assert free_bytes(str(tmp_path)) > 0 and free_bytes(str(tmp_path / "none")) is None
