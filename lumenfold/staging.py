"""Stages written as tables between the steps of a run: lineage ends there, and a lost executor costs one step."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def staging_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which a cluster's driver and executors share; a master of one process may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lumenfold-stages-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """``df`` as a written table, which stays until ``release`` or the end of the process."""
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_later(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_later(spark: SparkSession, path: str) -> None:
    """Let ``release``, or the end of the process, delete a folder."""
    if not _written:
        atexit.register(release, spark)
    _written.append(path)


def delete_all(spark: SparkSession, paths: list[str]) -> None:
    """Empty a list of folders, which any store may hold; also after the session was stopped."""
    if not paths:
        return
    jvm = spark._jvm
    conf = jvm.org.apache.hadoop.conf.Configuration() if spark.sparkContext._jsc is None else spark.sparkContext._jsc.hadoopConfiguration()
    while paths:
        path = jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(conf).delete(path, True)


def mark() -> int:
    """What has been staged so far, for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep_last: bool = False) -> None:
    """Delete the tables staged by this process, from a mark on; frames built on them can't be read afterwards."""
    stop = len(_written) - int(keep_last)
    gone, _written[since:stop] = _written[since:stop], []
    delete_all(spark, gone)
