"""Findings by the time of what they were found in: windows and sessions under a watermark, and what came too late for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.plans import pipeline


def found_at(paragraphs: DataFrame, config: pipeline.Config, keep: tuple[str, ...] = ("ts",)) -> DataFrame:
    """A row (keep, entity_type) for each finding in paragraphs (text, and the columns to keep); paragraphs may be a stream."""
    done = pipeline.analyse(paragraphs, config)
    return done.where(F.size("resolved") > 0).select(*keep, F.explode("resolved.entity_type").alias("entity_type"))


def by_window(found: DataFrame, size: str, delay: str, slide: str | None = None) -> DataFrame:
    """(start, end, entity_type, n) of windows of ts. On a stream each comes once, when the latest ts is delay beyond its end.

    Rows that come after their windows have been given out are left out. late() tells which rows may be: those whose
    windows the batches before had closed; a stream still takes them for one batch, as it goes by the watermark of the
    batch before.
    """
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    counted = found.withWatermark("ts", delay).groupBy(window.alias("w"), "entity_type").agg(F.count("*").alias("n"))
    return counted.select("w.start", "w.end", "entity_type", "n")


def by_session(found: DataFrame, gap: str, delay: str, *by: str) -> DataFrame:
    """(start, end, by, n) of sessions: findings of the same by with no more than gap from each to the next; the end is gap after the last."""
    counted = found.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return counted.select("w.start", "w.end", *by, "n")


def late(end: Column, latest: Column, delay: str) -> Column:
    """Whether a row whose last window ends at end is too late, latest being the greatest ts of the batches before its own."""
    return F.coalesce(end <= F.date_trunc("millisecond", latest) - F.expr(f"INTERVAL {delay}"), F.lit(False))


def write_with_late(found: DataFrame, size: str, delay: str, folder: str):
    """Starts a query that appends every batch's rows to folder/rows, with late: whether the batches before had closed its windows.

    The latest ts goes to folder/latest with each batch, so that a restart goes on where it stopped; a batch that is
    written again takes its own place.
    """
    spark, schema = found.sparkSession, "batch long, latest timestamp"

    def write(batch: DataFrame, number: int) -> None:
        spark_ = batch.sparkSession
        known = _latest(spark_, folder, schema, number)
        ends = batch.select("*", F.window("ts", size)["end"].alias("__end"))
        marked = ends.withColumn("late", late(F.col("__end"), F.lit(known).cast("timestamp"), delay)).drop("__end")
        marked.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/rows")
        batch.agg(F.lit(number).cast("long").alias("batch"), F.max("ts").alias("latest")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/latest/{number:012d}")

    return found.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()


def _latest(spark: SparkSession, folder: str, schema: str, number: int):
    """The greatest ts of the batches before."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{folder}/latest")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{folder}/latest")
    return rows.where(F.col("batch") < number).agg(F.max("latest")).first()[0]
