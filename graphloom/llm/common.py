"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space; a word is a maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: The most words of 64 bits that a filter of rows has, which all tasks hold; beyond that it lets more rows pass.
FILTER_WORDS = 1 << 20
#: Folders to delete at the end of each open temporary_tables(), the innermost last.
_frames: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, or a folder of our own where it is unset (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("graphloom.scratch.dir", None)
    if not path:
        path = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("graphloom.scratch.dir", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _delete(fs, folder) -> None:
    fs.cancelDeleteOnExit(folder)
    fs.delete(folder, True)


def materialize(df: DataFrame, name: str, outlives: bool = False) -> DataFrame:
    """Write the rows to the shared folder and read them again.

    It cuts the lineage like a checkpoint, yet columnar and compressed, and a
    lost executor loses none of it. The table goes with the innermost
    temporary_tables(), with ``outlives`` with the one around that, and at the
    latest with the session.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    fs, folder = _file_system(spark, path)
    fs.deleteOnExit(folder)
    if frames := _frames[: -1 if outlives else None]:
        frames[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete what materialize() writes inside, once done."""
    _frames.append([])
    try:
        yield
    finally:
        for path in _frames.pop():
            _delete(*_file_system(spark, path))


def task_count(df: DataFrame, each: int = 1 << 26) -> int:
    """Tasks for a shuffle of df: as many as are set, or more if the optimizer's estimate of its bytes asks for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    set_ = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(set_, -(-size // each)) if size < 1 << 60 else set_  # that large: unknown


def drop_scratch(df: DataFrame) -> None:
    """Delete what materialize() wrote for df, once nothing reads it any more."""
    if files := df.inputFiles():
        fs, file = _file_system(df.sparkSession, files[0])
        _delete(fs, file.getParent())


def shuffles_held(spark: SparkSession) -> int:
    """Shuffles whose files Spark keeps."""
    return spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()


def free_shuffles(spark: SparkSession, upto: int | None = None, patience: float = 5.0) -> None:
    """Let Spark delete the shuffle files behind what has been written: it does so once the driver's handles of them are collected.

    With ``upto``, wait until that many shuffles are left: Spark deletes in the
    background, after events of ended queries have reached all listeners.
    """
    gc.collect()
    if upto is not None:
        with suppress(Py4JJavaError):  # not empty in that time
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(int(patience * 1000))
    spark.sparkContext._jvm.System.gc()
    end = time.monotonic() + patience
    while upto is not None and shuffles_held(spark) > upto and time.monotonic() < end:
        time.sleep(0.1)


def flag_among(rows: DataFrame, h: Column, few: DataFrame) -> DataFrame:
    """Also ``among``: true for all rows whose hash h is in few (h long), and for one in 16 of the others as a rule.

    Wide rows that an exact join with few rows would drop, or would not need to
    meet, can so be told apart where they are read. The filter goes as
    materialize() with ``outlives`` has it.
    """
    words = 1 << max(0, math.ceil(math.log2(max(1, few.count()) / 4)))
    words = min(words, FILTER_WORDS)
    word = lambda x: F.pmod(F.shiftrightunsigned(x, 6), F.lit(words))
    bit = lambda x: x.bitwiseAND(F.lit(63).cast("long")).cast("int")
    bits = few.groupBy(word(F.col("h")).alias("__word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("h")))).alias("__bits"))
    bits = F.broadcast(materialize(bits, "filter", outlives=True))
    met = rows.withColumn("__h", h).join(bits, word(F.col("__h")) == F.col("__word"), "left")
    return met.select(*rows.columns, (F.bit_get(F.coalesce("__bits", F.lit(0).cast("long")), bit(F.col("__h"))) == 1).alias("among"))


def pieces(batch: pa.RecordBatch, text: int, rows: int = 1000, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of so many rows, and so many bytes of the text column, at most; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
        yield batch.slice(at, n := min(rows, max(1, upto - at)))
        at += n


def release_memory() -> None:
    """Give memory that this process has freed back to the system; allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function for mapInArrow after which the worker, which Spark keeps for other tasks, holds no memory it does not need."""

    @wraps(run)
    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return released


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running(rows: DataFrame, order: list, sums: dict[str, Column], name: str) -> DataFrame:
    """Also the sums over all rows up to and with each, in the order of ``order``, without one task for all.

    Rows are cut into ranges of the order; sums within a range are shifted by
    those of the ranges before it, of which there are as many as shuffle partitions.
    """
    cut = materialize(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), name)
    totals = cut.groupBy("__range").agg(*(F.sum(x).alias(k) for k, x in sums.items()))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(F.col("__range").alias("__at"), *(F.sum(k).over(ahead).alias(f"__{k}") for k in sums))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = cut.select("*", *(F.sum(x).over(inside).alias(k) for k, x in sums.items())).join(F.broadcast(shifts), F.col("__range") == F.col("__at"))
    return met.select(*rows.columns, *((F.col(k) + F.coalesce(F.col(f"__{k}"), F.lit(0))).alias(k) for k in sums))
