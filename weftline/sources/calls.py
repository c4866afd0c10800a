"""The call log: JSON lines in monthly folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.runlog import calls_between, month_of
from weftline.schema import CALLS, JSON_TIME, JSON_TIME_READ


def write_calls(calls: DataFrame, path: str, mode: str = "append") -> None:
    """One folder a calendar month; rows of a month are gathered so that a write makes few files, and a hot month can still be split."""
    calls.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("month", month_of()).hint("rebalance", "month").write.mode(mode).partitionBy("month").option("timestampFormat", JSON_TIME).json(path)


def read_calls(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The log, or the calls of a closed time range, of which only the months' folders are read."""
    calls = spark.read.schema(CALLS + ", month string").option("timestampFormat", JSON_TIME_READ).json(path)
    return (calls_between(calls, start, end) if start and end else calls).drop("month")


def drop_old_months(spark: SparkSession, path: str, now: str, months: int) -> list[str]:
    """Deletes month folders more than `months` whole months before `now`; returns their names."""
    first = spark.range(1).select(F.date_format(F.add_months(F.trunc(F.lit(now).cast("date"), "month"), -months), "yyyy-MM")).first()[0]
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("month=") and s.getPath().getName()[6:] < first]
    for p in gone:
        fs.delete(p, True)
    return sorted(p.getName()[6:] for p in gone)
