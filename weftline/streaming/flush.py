"""Structured Streaming over the call log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.runlog import month_of
from weftline.schema import CALLS, JSON_TIME, JSON_TIME_READ


def flush_calls(spark: SparkSession, source: str, target: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Appends new JSON lines to monthly folders: every `every` ("30 seconds"), or what is there now and then stops. Exactly once, by the checkpoint."""
    calls = spark.readStream.schema(CALLS).option("timestampFormat", JSON_TIME_READ).json(source).withColumn("month", month_of())
    w = calls.writeStream.format("json").option("timestampFormat", JSON_TIME).partitionBy("month").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def daily_stream(calls: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Calls, successes and mean ms of each day, final once the watermark has passed it."""
    day = F.window("ts", "1 day")
    g = calls.withWatermark("ts", lateness).groupBy(day.alias("w"))
    return g.agg(F.count("*").alias("total"), F.count_if("success").alias("succeeded"), F.avg("duration_ms").alias("mean_ms")).select(F.to_date("w.start").alias("day"), "total", "succeeded", "mean_ms")
