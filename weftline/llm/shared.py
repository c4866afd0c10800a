"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession

ARROW_BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and the master is local, a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="weftline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def bound_batches(spark: SparkSession, most: int = ARROW_BATCH_BYTES) -> None:
    """Arrow batches end at `most` bytes, so that long texts don't gather in one batch."""
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if not (now and now.isdigit() and 0 < int(now) <= most):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


class Scratch:
    """A folder for the written tables of one run; `drop` deletes what the result no longer needs."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it back: the lineage ends at the files, which survive lost executors."""
        df.write.mode("error").parquet(path := f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, *names: str) -> None:
        """Drops all tables but these."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        self.drop(*(n for n in (f.getPath().getName() for f in found) if n not in names))


def give_back() -> None:
    """Returns this process's freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A batch function after which the worker, which lives on, holds no freed memory."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
