"""Cutting lineage through tables in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Folders to delete at the end of each open temporary_tables(), the innermost last.
_frames: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir where it is set; a folder of our own only where it is not."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("graphloom.scratch.dir", None)
    if not path:
        path = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("graphloom.scratch.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.cancelDeleteOnExit(p)
    fs.delete(p, True)


def cut(df: DataFrame, name: str, owner: list[str] | None = None) -> DataFrame:
    """Write df once and read it back: later steps neither recompute it nor lose it with an executor.

    The table goes with the innermost temporary_tables(), or with what keeps
    the list ``owner``, and at the latest with the session.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    if owner is not None:
        owner.append(path)
    elif _frames:
        _frames[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete what cut() writes inside, once done."""
    _frames.append([])
    try:
        yield
    finally:
        for path in _frames.pop():
            delete(spark, path)
