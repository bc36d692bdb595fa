"""Intermediate tables in the folder that the driver and all executors share, and their removal."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_SHARED = "/tmp/checkpoints"  # only where spark.checkpoint.dir is unset and Spark runs in one process, as in tests
_LOCAL = threading.local()  # operators called from several threads of one driver never see each other's tables


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. On a cluster spark.checkpoint.dir has to name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    return (folder or LOCAL_SHARED).rstrip("/")


def _own() -> list[str]:
    return _LOCAL.__dict__.setdefault("written", [])


def new_folder(spark: SparkSession, tag: str) -> str:
    """A folder that finished() deletes with the tables."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _own().append(path)
    return path


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read again, so that later plans know the table's size."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def many_tasks(spark: SparkSession) -> int:
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal narrow rows over all cores before work that takes long or writes much a row: a small compressed file is few
    splits, so that its rows would be few tasks' work. The number is given, so that it is not coalesced for small bytes."""
    return df.repartition(many_tasks(df.sparkSession), *keys)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _own().remove(path)


def release(df: DataFrame) -> None:
    """Delete the files of a stage() of this thread that no later plan reads; other files are never touched."""
    for path in {w for f in df.inputFiles() for w in _own() if f"/{w.rpartition('/')[2]}/" in f}:
        _delete(df.sparkSession, path)


def mark() -> int:
    """The number of this thread's folders, for finished()."""
    return len(_own())


def finished(df: DataFrame, tag: str, since: int) -> DataFrame:
    """Stage a result, and delete every folder that this thread has written since mark()."""
    before = _own()[since:]
    out = stage(df, tag)
    for path in before:
        _delete(df.sparkSession, path)
    return out
