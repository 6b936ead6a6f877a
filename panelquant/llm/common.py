"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset a local session takes its warehouse; on a
    cluster that may be a machine's own disk, so it is an error there."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"


def settle(df: DataFrame) -> DataFrame:
    """Write rows to the shared folder and go on from the files: lineage is cut in a place that outlives lost executors."""
    path = new_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_settled(df: DataFrame) -> None:
    """Delete the files that a ``settle``d frame reads, when nothing reads them any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished jobs. Spark deletes them once the driver's collectors have found the plans that
    made them dead, which on a roomy heap may be long after; steps with large shuffles one after the other ask for it."""
    gc.collect()
    spark._jvm.System.gc()


BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Python workers get whole texts in batches of some ``BATCH_BYTES``; a smaller bound of the session stays.

    Spark's own bound is 10,000 rows, however long: the JVM and the worker of each task hold several copies of a batch, so an
    executor's memory would grow with the texts. A longer text is a batch of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


_HELD: dict[str, list] = {}  # of a Python worker, by step: key, tables, the stage that used them last
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library


def give_back() -> None:
    """Freed memory back to the system, so that a worker between tasks holds what it remembers and not what its last batch took."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def let_go(step: str) -> None:
    """Drop the tables of steps other than ``step`` that ended: Spark reuses Python workers, so a worker would keep those of every
    step that it ever ran. Steps that share a stage keep theirs."""
    now = TaskContext.get()
    stage = now.stageId() if now else None
    ended = [k for k, (_, _, last) in _HELD.items() if k != step and last != stage]
    for k in ended:
        del _HELD[k]
    if ended:
        gc.collect()
        give_back()
    if step in _HELD:
        _HELD[step][2] = stage


def held(step: str, key, make: Callable):
    """The tables that a worker keeps from batch to batch for ``step``, made anew for another key."""
    let_go(step)
    if step not in _HELD or _HELD[step][0] != key:
        _HELD.pop(step, None)
        now = TaskContext.get()
        _HELD[step] = [key, make(), now.stageId() if now else None]
    return _HELD[step][1]


def number_lists(rows: list[np.ndarray], dtype) -> pa.ListArray:
    """A list of each array, made of the arrays' memory: as Python's numbers they would take five times as much."""
    ends = np.cumsum([0, *map(len, rows)])
    flat = np.concatenate(rows).astype(dtype, copy=False) if rows else np.zeros(0, dtype)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ids_text(parts: Column) -> Column:
    return F.array_join(parts, ",")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)
