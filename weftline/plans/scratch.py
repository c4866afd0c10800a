"""Written tables that cut the lineage of iterative plans.

Tables go to the folder in spark.checkpoint.dir, which driver and executors share, so
they survive lost executors. Where the setting is absent and the master is local, a
folder of its own serves.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="weftline-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Rounds:
    """The tables of an iteration; `keep` writes one and reads it back, `forget` deletes it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(path := f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
