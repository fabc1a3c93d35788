"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only in local mode, where that is unset."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = f"{tempfile.gettempdir()}/maskwright"
    return place.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that shuffles both sides, whatever the sizes of files say.

    Files of texts that are alike are so small that Spark takes tables of any number of rows for ones to send whole through
    the driver.
    """
    return df.hint("merge")


class Tables:
    """Parquet tables that cut lineage, so that a lost executor costs no recomputation; they go when the driver's Python ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.count = spark, 0
        self.root = f"{shared_folder(spark)}/work-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def _end(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:
            pass  # the gateway to the JVM has gone before

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{self.count:03d}-{name}"
        self.count += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
