from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenfold.skew import FEW_ROWS, has_heavy, join_per_key

ROWS = [(k, None if k % 7 == 0 else ("hot" if k % 2 else f"k{k % 40}")) for k in range(3000)]


@pytest.mark.parametrize("total", [None, 3000])
@pytest.mark.parametrize("rows", [ROWS, [(k, f"k{k % 40}") for k in range(400)], []])
def test_join_per_key_is_a_left_join(spark, rows, total):
    d = spark.createDataFrame(rows, "id long, key string")
    per_key = d.filter("key IS NOT NULL AND key <> 'k3'").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    expected = {r.id: r.least for r in d.join(per_key, "key", "left").collect()}
    got = join_per_key(d, per_key, ["key"], "n", ["id"], total)
    assert got.columns == ["id", "key", "least"]
    rows_got = got.collect()
    assert {r.id: r.least for r in rows_got} == expected and len(rows_got) == len(rows)


def test_rows_of_a_heavy_key_and_of_none_are_dealt_out(spark):
    d = spark.createDataFrame(ROWS, "id long, key string").repartition(8)
    per_key = d.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = join_per_key(d, per_key, ["key"], "n", ["id"]).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert max(r["count"] for r in got) < 1000 and len(got) >= 4


def test_few_rows_arent_heavy():
    assert not has_heavy(None, None) and not has_heavy(FEW_ROWS, 1) and has_heavy(FEW_ROWS + 1, 1000) and not has_heavy(5000, 10**8)
