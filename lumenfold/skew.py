"""Joins that no frequent key turns into one task's work."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than one in HEAVY_SHARE of all rows, so there are fewer than that
#: many, and more than FEW_ROWS rows.
HEAVY_SHARE, FEW_ROWS = 1000, 200


def has_heavy(most: int | None, total: int | None) -> bool:
    return (most or 0) > FEW_ROWS and (most or 0) * HEAVY_SHARE > (total or 0)


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: list[str], count: str, spread: list[str], total: int | None = None) -> DataFrame:
    """Left join of ``rows`` with one row per key, without a task that gets a heavy key's rows.

    ``per_key.count`` is the number of ``rows`` of each key. Heavy keys, at most HEAVY_SHARE by
    definition, are broadcast; their rows are then dealt by ``spread`` through the shuffled join of
    the rest, where they match nothing. So are rows that have a null key. Without a heavy key the
    join is plain. ``per_key`` is asked for its counts once, and should be a written table; with
    ``total``, a number of rows not below the real one, it isn't asked and keys are assumed heavy.
    """
    values = [c for c in per_key.columns if c not in keys and c != count]
    heavy_there = True
    if total is None:
        total, most = per_key.agg(F.sum(count), F.max(count)).first()
        heavy_there = has_heavy(most, total)
    place = F.pmod(F.xxhash64(*spread), F.lit(1 << 20)).cast("int") + 1
    no_key = reduce(or_, (F.col(k).isNull() for k in keys))
    if not heavy_there:
        light = per_key.select(*keys, F.lit(0).alias("_salt"), *values)
        joined = rows.withColumn("_salt", F.when(no_key, place).otherwise(0)).join(light, [*keys, "_salt"], "left")
        return joined.select(*rows.columns, *values)
    is_heavy = (F.col(count) * HEAVY_SHARE > (total or 0)) & (F.col(count) > FEW_ROWS)
    heavy = per_key.filter(is_heavy).select(*keys, *(F.col(v).alias(f"_heavy_{v}") for v in values), F.lit(True).alias("_heavy"))
    light = per_key.filter(~is_heavy).select(*keys, F.lit(0).alias("_salt"), *values)
    dealt = rows.join(F.broadcast(heavy), keys, "left").withColumn("_salt", F.when(F.col("_heavy") | no_key, place).otherwise(0))
    joined = dealt.join(light, [*keys, "_salt"], "left")
    return joined.select(*rows.columns, *(F.coalesce(f"_heavy_{v}", v).alias(v) for v in values))
