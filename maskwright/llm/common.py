"""What the operators share: the shared folder, written tables, loading, Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset (tests, local mode)."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = f"{tempfile.gettempdir()}/maskwright-checkpoints"
    return place.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


class Written:
    """Tables that cut lineage: Parquet files in the shared folder, so a lost executor costs no recomputation.

    What a result still reads stays until the driver's Python ends, and is deleted then.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self._end)

    def _end(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:
            pass  # the gateway to the JVM has gone before

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{self.count:03d}-{name}"
        self.count += 1
        with shuffles_dropped(self.spark):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.written_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Deletes a table that nothing will read again."""
        if path := getattr(df, "written_path", None):
            delete(self.spark, path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside delete their shuffle files when they end, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def delete(spark: SparkSession, path: str) -> None:
    fs, place = _file_system(spark, path)
    fs.delete(place, True)


def subfolders(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """Names of the folders in a folder, and whether Spark has finished writing each; none if it isn't there."""
    fs, place = _file_system(spark, path)
    if not fs.exists(place):
        return []
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [(x.getPath().getName(), fs.exists(mark(x.getPath(), "_SUCCESS"))) for x in fs.listStatus(place) if x.isDirectory()]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def _keep_little() -> None:
    """Very large blocks of memory go back to the system when they are freed."""
    import ctypes

    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 25)  # from this size on, blocks are mapped apart; smaller ones are used again until the task is over
        libc.mallopt(-8, 2)  # arenas
    except (OSError, AttributeError):
        pass  # another C library


#: What a Python worker remembers from task to task, by purpose.
REMEMBERED: dict[str, dict] = {}


def lean(run, remember: str | None = None):
    """A function for mapInArrow whose memory goes back to the system when its task is over.

    Only what has been remembered for its own purpose outlives the start of a task.
    """

    def task(batches):
        import ctypes

        from maskwright.llm import common

        for purpose in [p for p in common.REMEMBERED if p != remember]:
            del common.REMEMBERED[purpose]
        common._keep_little()
        yield from run(batches)
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass

    return task


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; null is the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about most_bytes of text, a single longer text alone."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        at, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > most_bytes:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < batch.num_rows:
            yield batch.slice(at)
