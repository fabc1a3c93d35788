"""Pairs of spans that overlap, by an equi-join on places in the text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _level(start: Column, end: Column) -> Column:
    """The least power of two that is at least the span's length."""
    return F.length(F.bin(F.greatest(end - start - 1, F.lit(0)))) * (end - start > 1).cast("int")


def overlapping(one: DataFrame, other: DataFrame, keys: Sequence[str] = ("doc_id", "seq"), start: str = "start", end: str = "end") -> DataFrame:
    """(keys, one, other, shared): the rows of both tables with the same keys whose spans, ends excluded, share code points, and how many.

    A span lies in one or two bins of the power of two that its length comes up to. Two spans meet in the bins of the
    longer one's size, where the shorter one lies in two bins at most as well, and count in that where the later of them
    starts: each pair comes once. A text of any length is spread over its bins; pairs that don't meet there are never
    made. Empty spans overlap nothing, nor do rows with a null key, start or end; repeated rows each count.
    """
    sizes = lambda df: df.where(F.col(end) > F.col(start)).select(_level(F.col(start), F.col(end)).alias("level")).distinct()
    levels = sorted(r[0] for r in sizes(one).union(sizes(other)).distinct().collect())  # 32 at most

    def placed(df: DataFrame, name: str) -> DataFrame:
        rows = df.where(F.col(end) > F.col(start)).select(*keys, F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in keys]).alias(name), F.col(start).alias(f"{name}_start"), F.col(end).alias(f"{name}_end"))
        a, b = F.col(f"{name}_start"), F.col(f"{name}_end")
        rows = rows.withColumn(f"{name}_level", _level(a, b))
        rows = rows.withColumn("level", F.explode(F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x >= F.col(f"{name}_level"))))
        size = F.expr("shiftleft(1L, level)")
        return rows.withColumn("bin", F.explode(F.sequence(F.floor(a / size).cast("long"), F.floor((b - 1) / size).cast("long"))))

    met = placed(one, "one").join(placed(other, "other"), [*keys, "level", "bin"])
    later = F.greatest("one_start", "other_start")
    first = F.floor(later / F.expr("shiftleft(1L, level)")).cast("long") == F.col("bin")
    longer = F.greatest("one_level", "other_level") == F.col("level")
    shared = F.least("one_end", "other_end") - later
    return met.where(longer & first & (shared > 0)).select(*keys, "one", "other", shared.cast("int").alias("shared"))
