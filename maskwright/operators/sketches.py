"""Numbers of distinct values by sketches that are kept and merged, instead of counting all rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sketches of 2**PRECISION registers, at most some 4 kB each.
PRECISION = 12


def error(precision: int = PRECISION) -> float:
    """The standard error of an estimate, as a share of the number itself; small numbers are nearly exact."""
    return 1.04 / 2 ** (precision / 2)


def sketched(rows: DataFrame, keys: tuple[str, ...], value: str, precision: int = PRECISION) -> DataFrame:
    """(keys, n, sketch): of each group the number of rows and a sketch of its distinct values; null values count in n only.

    Tasks send one sketch for each of their groups, so a hot group costs no more than another.
    """
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col(value).cast("string"), F.lit(precision)).alias("sketch"))


def merged(sketches: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """sketched() over fewer keys, from the sketches alone; a group's values count once, however many sketches hold them."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("sketch").alias("sketch"))


def estimated(sketches: DataFrame) -> DataFrame:
    """The sketches with n_distinct in the sketch's place."""
    return sketches.withColumn("n_distinct", F.hll_sketch_estimate("sketch")).drop("sketch")


def add(sketches: DataFrame, folder: str, batch: int) -> None:
    """Puts a batch's sketches into the folder; the same batch once more takes its own place, as after a stream's restart."""
    sketches.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def kept(spark: SparkSession, folder: str) -> DataFrame:
    """All sketches of a folder, with their batch."""
    return spark.read.parquet(folder)
