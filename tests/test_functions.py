"""Names, paths, media types and dates."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import dates, mime, paths, sidecar_names
from lumenfold.functions.unicode import nfc
from lumenfold.operators.classify import is_year_folder
from lumenfold.operators.dedup import name_rank
from lumenfold.operators.extras import is_extra


def apply(spark, values, f):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in rows.orderBy("k").select(f(F.col("v")).alias("o")).collect()]


NAMED = {
    "Screenshot_20190919-053857_Camera-edited.jpg": datetime(2019, 9, 19, 5, 38, 57),
    "MVIMG_20190215_193501.MP4": datetime(2019, 2, 15, 19, 35, 1),
    "Screenshot_2019-04-16-11-19-37-232_com.jpg": datetime(2019, 4, 16, 11, 19, 37),
    "signal-2020-10-26-163832.jpg": datetime(2020, 10, 26, 16, 38, 32),
    "VID_20220107_113306.mp4": datetime(2022, 1, 7, 11, 33, 6),
    "00004XTR_00004_BURST20190216172030.jpg": datetime(2019, 2, 16, 17, 20, 30),
    "00055IMG_00055_BURST20190216172030_COVER.jpg": datetime(2019, 2, 16, 17, 20, 30),
    "2016_01_30_11_49_15.mp4": datetime(2016, 1, 30, 11, 49, 15),
    "201801261147521000.jpg": datetime(2018, 1, 26, 11, 47, 52),
    "IMG_1_BURST20160623205107_COVER.jpg": datetime(2016, 6, 23, 20, 51, 7),
    "IMG_1_BURST20160520195318.jpg": datetime(2016, 5, 20, 19, 53, 18),
    "1990_06_16_07_30_00.jpg": datetime(1990, 6, 16, 7, 30),
    "1869_12_30_16_59_57.jpg": datetime(1869, 12, 30, 16, 59, 57),
    # the calendar overflows instead of failing
    "IMG_20190231_990506.jpg": datetime(2019, 3, 7, 3, 5, 6),
    "IMG_20190300_000000.jpg": datetime(2019, 2, 28),
    "holiday.jpg": None,
    "IMG_20191350_000000.jpg": None,
}


def test_guess_from_name(spark):
    assert apply(spark, NAMED, dates.guess_from_name) == list(NAMED.values())


def test_first_pattern_wins_over_leftmost_position(spark):
    assert apply(spark, ["2016_01_30_11_49_15 20190215_193501.jpg"], dates.guess_from_name) == [datetime(2019, 2, 15, 19, 35, 1)]


@pytest.mark.parametrize(
    ("f", "name", "expected"),
    [
        (sidecar_names.identity, "a.jpg", "a.jpg"),
        (sidecar_names.shortened, "Screenshot_2022-10-28-09-31-43-118_com.snapchat.jpg", "Screenshot_2022-10-28-09-31-43-118_com.snapcha"),
        (sidecar_names.shortened, "Urlaub in Knaufspesch in der Schneifel (38).JPG", "Urlaub in Knaufspesch in der Schneifel (38).JP"),
        (sidecar_names.shortened, "a" * 46, "a" * 46),
        (sidecar_names.bracket_swapped, "img_(87).(vacation stuff).lol(87).jpg", "img_(87).(vacation stuff).lol.jpg(87)"),
        (sidecar_names.bracket_swapped, "image(3).(2)(3).jpg", "image(3).(2).jpg(3)"),
        (sidecar_names.bracket_swapped, "plain.jpg", "plain.jpg"),
        # the last match is "(1).", the last text "(1)" stands later
        (sidecar_names.bracket_swapped, "a(1).b(1)c", "a(1).bc(1)"),
        (sidecar_names.extra_removed, "IMG-20150125-WA0003-modifié.jpg", "IMG-20150125-WA0003.jpg"),
        (sidecar_names.extra_removed, "IMG-20150125-WA0003-modifié.jpg", "IMG-20150125-WA0003.jpg"),
        (sidecar_names.extra_removed, "a-EDITED.jpg", "a-EDITED.jpg"),
        (sidecar_names.extra_removed, "a-edited-edited.jpg", "a-edited.jpg"),
        (sidecar_names.extension_removed, "20030616.jpg", "20030616"),
        (sidecar_names.any_extra_removed, "simple_file_20200101-edited(1).jpg", "simple_file_20200101.jpg"),
        (sidecar_names.any_extra_removed, "IMG-20150125-WA0003-modifié(1).jpg", "IMG-20150125-WA0003.jpg"),
        (sidecar_names.any_extra_removed, "a-x-x.jpg", "a.jpg"),
        (sidecar_names.digit_removed, "a(1).jpg", "a.jpg"),
        (sidecar_names.digit_removed, "a(11).jpg", "a(11).jpg"),
        (paths.stem, "a.b.jpg", "a.b"),
        (paths.stem, ".bashrc", ".bashrc"),
        (paths.stem, "noext", "noext"),
        (paths.extension, "a.b.jpg", ".jpg"),
        (paths.extension, ".bashrc", ""),
        (paths.basename, "/x/y.z/a b%20#.jpg", "a b%20#.jpg"),
        (paths.dirname, "/x/y.z/a.jpg", "/x/y.z"),
        (nfc, "é", "é"),
        (nfc, "plain", "plain"),
        (dates.normalise_exif, "2022:12:16 16:06:47", "2022-12-16 16:06:47"),
        (dates.normalise_exif, "2022/ 2/ 5 10.11.12", "2022-02-05 10:11:12"),
        (dates.normalise_exif, "1999-06-23 23:55", "1999-06-23 23:55"),
    ],
)
def test_name_functions(spark, f, name, expected):
    assert apply(spark, [name, None], f) == [expected, None]


def test_replace_last(spark):
    cases = [("aXbXc", "X", "aXbc"), ("none", "X", "none"), ("XX", "X", "X"), ("abab", "ab", "ab"), ("a", "", "a")]
    rows = spark.createDataFrame(cases, "s string, old string, expected string")
    assert all(r[0] == r[1] for r in rows.select(paths.replace_last(F.col("s"), F.col("old"), F.lit("")), "expected").collect())


def test_exif_dates(spark):
    given = ["2022:12:16 16:06:47", "2019:02:31 99:05:06", "0000:00:00 00:00:00", "1999:06:23 23:55", "garbage", None, ""]
    assert apply(spark, given, dates.parse_exif) == [datetime(2022, 12, 16, 16, 6, 47), datetime(2019, 3, 7, 3, 5, 6), None, datetime(1999, 6, 23, 23, 55), None, None, None]


def test_sidecar_bodies(spark):
    given = ['{"photoTakenTime": {"timestamp": "1599078832"}}', '{"photoTakenTime": {"timestamp": 1599078832}}', '{"photoTakenTime": {"timestamp": "1.5"}}', '{"photoTakenTime": {"timestamp": null}}', "{}", "[1]", "{broken", "", None]
    assert apply(spark, given, dates.sidecar_epoch) == [1599078832, 1599078832] + [None] * 7


def test_media_types(spark):
    given = ["a.jpg", "lol.json", "b.mp4", "c.3gp", "e.png", "f.txt", "x.MP4", "y.mts", "jpg", "z.HEIC", None]
    assert apply(spark, given, mime.is_media) == [True, False, True, True, True, False, True, True, False, True, None]
    assert apply(spark, given[:3], mime.is_image) == [True, False, False]


def test_year_folders(spark):
    assert apply(spark, ["Photos from 2025", "Photos from 1969", "Photos from vacation", "Photos from 2025\n", "Photos from 1799"], is_year_folder) == [True, True, False, False, False]


def test_extras(spark):
    given = ["image-edited.jpg", "a-EDITED.JPG", "a-edited(1).jpg", "a-modifié.jpg", "a-modifié.jpg", "edited.jpg", "x-編集済み.png"]
    assert apply(spark, given, is_extra) == [True, True, False, True, True, False, True]


def test_name_rank_compares_as_text(spark):
    rows = spark.createDataFrame([("a" * 9,), ("a" * 10,)], "name string").select(name_rank(F.lit(None).cast("int"), F.col("name")).alias("r"))
    assert sorted(r[0] for r in rows.collect()) == ["99910", "9999"]


def test_human_size(spark):
    got = spark.createDataFrame([(10,), (2048,), (5 * 1024**3 // 2,)], "n long").select(paths.human_size(F.col("n"))).collect()
    assert [r[0] for r in got] == ["10 B", "2.00 KiB", "2.50 GiB"]


def test_human_size_rounds_ties_to_even(spark):
    sizes = [k * 262144 for k in (4608, 5632, 10752, 4609, 4607, 8191 * 512)] + [1029, 1024**2 - 1, 1024**4]
    got = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "k int, n long").orderBy("k").select(paths.human_size(F.col("n"))).collect()
    n = [next((s / 1024**k, u) for k, u in ((4, "TiB"), (3, "GiB"), (2, "MiB"), (1, "KiB")) if s >= 1024**k) for s in sizes]
    assert [r[0] for r in got] == [f"{v:.2f} {u}" for v, u in n]
    assert [r[0] for r in got][:3] == ["1.12 GiB", "1.38 GiB", "2.62 GiB"]
