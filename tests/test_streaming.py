from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lumenfold.streaming import arrivals

SCHEMA = "album string, name string, size long, content_key string, mtime timestamp"


def run(spark, tmp_path, batches, f):
    source = str(tmp_path / "in")
    for b in batches:
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = f(stream).writeStream.format("memory").queryName("arrived").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("arrived")


def at(hour, day=1):
    return dt.datetime(2024, 1, day, hour)


def test_first_arrivals(spark, tmp_path):
    got = run(spark, tmp_path, [[("A", "a.jpg", 1, "x", at(1)), (None, "a.jpg", 1, "x", at(1))], [("A", "b.jpg", 1, "x", at(2)), ("A", "c-edited.jpg", 2, "y", at(3))]], lambda s: arrivals.without_extras(arrivals.first_arrivals(s)))
    assert sorted((r.album or "", r.content_key) for r in got.collect()) == [("", "x"), ("A", "x")]


def test_windows_close_behind_the_watermark(spark, tmp_path):
    got = run(spark, tmp_path, [[("A", "a.jpg", 1, "x", at(1)), ("A", "b.jpg", 2, "y", at(1))], [("A", "c.jpg", 5, "z", at(1, 4))], [("A", "d.jpg", 5, "w", at(2, 4))]], lambda s: arrivals.arrivals_per_window(s, late="1 hour"))
    assert [(r.files, r.bytes) for r in got.orderBy("window_start").limit(1).collect()] == [(2, 3)]
    assert got.agg(F.sum("files")).first()[0] >= 2
