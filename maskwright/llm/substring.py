"""Substring deduplication with a log-structured index of window hashes."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import repeats
from maskwright.llm.common import Written, delete, lean, record_batch, shuffle_width, shuffles_dropped, slices, subfolders


def word_windows(window: int = 20) -> repeats.Kind:
    return repeats.Kind(words=True, window=window, gram=min(window, max(1, window // 5)), piece=1 << 16)


#: Hash ranges that a bucket of an index is made of: more ranges than buckets even the buckets out.
SLOTS = 16
RUN = re.compile(r"run-w(\d+)-b(\d+)-(\d+)-(\d+)")


class Index:
    """A log-structured index of the windows of all documents so far, in a folder of the shared storage.

    A run holds a generation's blocks (windows that share their least gram, whose hash is their fingerprint) that no
    earlier one has, in buckets of slots of hashes, sorted within. Runs are written once and never changed. add() deals a
    new generation's blocks to the same buckets and merges them with all runs there: each run is read where it lies, and
    only the new blocks are shuffled. Fingerprints that meet are verified word by word; what is new becomes the next run.
    Where there are more than fanout runs they are compacted into one.

    A later session goes on with Index(spark, path): the folder has all that is needed.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = 20, fanout: int = 2):
        self.spark, self.kind, self.fanout = spark, word_windows(window), fanout
        self.written = Written(spark)
        self.path = path.rstrip("/") if path else f"{self.written.root}/index"
        self.runs: list[tuple[int, int, str]] = []  # first and last generation, table
        found = [(name, whole, *map(int, m.groups())) for name, whole in subfolders(spark, self.path) if (m := RUN.fullmatch(name))]
        if any(x[2:4] != (window, found[0][3]) for x in found):
            raise ValueError(f"{self.path} holds runs of another window, or of different numbers of buckets")
        self.buckets = found[0][3] if found else shuffle_width(spark)
        end = -1
        for name, whole, _, _, first, last in sorted(found, key=lambda x: (x[4], -x[5], not x[1])):
            if last <= end or not whole:  # a compacted run covers it, or its writer was lost
                delete(spark, f"{self.path}/{name}")
            else:
                self.runs.append((first, last, self._opened(name)))
                end = last

    @property
    def generations(self) -> int:
        return self.runs[-1][1] + 1 if self.runs else 0

    def _name(self, first: int, last: int) -> str:
        return f"run-w{self.kind.window}-b{self.buckets}-{first:06d}-{last:06d}"

    def _opened(self, folder: str) -> str:
        table = f"maskwright_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {table} ({repeats.ROWS}, slot int) USING parquet CLUSTERED BY (slot) SORTED BY (slot, g) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{folder}'")
        return table

    def _put(self, rows: DataFrame, first: int, last: int) -> tuple[int, int, str]:
        table, name = f"maskwright_{uuid.uuid4().hex}", self._name(first, last)
        with shuffles_dropped(self.spark):
            rows.write.bucketBy(self.buckets, "slot").sortBy("slot", "g").option("path", f"{self.path}/{name}").option("compression", "zstd").mode("overwrite").format("parquet").saveAsTable(table)
        return first, last, table

    def _drop(self, run: tuple[int, int, str]) -> None:
        self.spark.sql(f"DROP TABLE {run[2]}")
        delete(self.spark, f"{self.path}/{self._name(run[0], run[1])}")

    def _slotted(self, rows: DataFrame) -> DataFrame:
        # as nullable as a table's column, or Spark wouldn't see that both are dealt alike
        return rows.withColumn("own_slot", F.when(F.col("g").isNotNull(), F.pmod(F.xxhash64("g"), F.lit(SLOTS * self.buckets)).cast("int")))

    def _aligned(self, tables: list[DataFrame]) -> DataFrame:
        """The union of tables in buckets, bucket by bucket; dealt anew where Spark can't keep it so."""
        rows = repeats.union(tables)
        plan = rows._jdf.queryExecution().sparkPlan()
        if not plan.outputPartitioning().toString().startswith("hashpartitioning(own_slot") or plan.supportsColumnar():
            rows = rows.repartition(self.buckets, "own_slot")
        return rows

    def _blocks(self, run: tuple[int, int, str]) -> DataFrame:
        """A run's blocks, as scan() gives them."""
        # by another name: columns of different tables wouldn't be taken for the same
        return self.spark.table(run[2]).where("n < 0").select(*[(-F.col("n")).alias("n") if c == "n" else c for c in repeats.SCHEMA.names], F.col("slot").alias("own_slot"))

    def _merged(self, rows: DataFrame, work) -> DataFrame:
        """work(batches) over rows that lie in their buckets, slot by slot, by ascending hashes; what comes of a slot stays in it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = next(batches, None)
            if first is None:
                return
            slot = first.column("own_slot")[0]
            for out in lean(work)(b.drop_columns(["own_slot"]) for b in chain([first], batches)):
                yield pa.RecordBatch.from_arrays([*out.columns, pa.repeat(slot, out.num_rows)], names=[*out.schema.names, "slot"])

        return rows.sortWithinPartitions("own_slot", "g").groupBy("own_slot").applyInArrow(run, f"{repeats.ROWS}, slot int")

    def add(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """docs (doc, copy, text), later than all that have been added -> spans (doc, copy, lo, hi) of words that windows repeat, ends included.

        last: nothing will ever be added after these, so they leave no blocks behind.
        """
        gen, kind = self.generations, self.kind
        new = self._slotted(repeats.scan(docs, kind, gen)).repartition(self.buckets, "own_slot")
        rows = self._aligned([*map(self._blocks, self.runs), new])
        run = self._put(self._merged(rows, lambda batches: repeats.settle(batches, kind, gen, keep=not last)), gen, gen)
        self.runs.append(run)
        spans = repeats.dealt(self.spark.table(run[2]), kind, gen, self.written)
        spans = self.written.put(spans, "spans")
        if len(self.runs) > self.fanout and not last:
            self._compact()
        return spans

    def _compact(self) -> None:
        old = self.runs
        rows = self._aligned(list(map(self._blocks, old)))

        def earliest(batches):
            for out in repeats.distinct_blocks(batches):
                yield out.set_column(out.schema.get_field_index("n"), repeats.SCHEMA.field("n"), pc.negate(out.column("n")))

        self.runs = [self._put(self._merged(rows, earliest), old[0][0], old[-1][1])]
        for run in old:
            self._drop(run)

    def delete(self) -> None:
        for run in self.runs:
            self._drop(run)
        self.runs = []


def batches_by_id(texts: DataFrame, count: int) -> list[DataFrame]:
    """texts (doc, ...) in count ranges of ids of about the same number of rows, ascending."""
    if count <= 1:
        return [texts]
    cuts = texts.agg(F.percentile_approx("doc", [i / count for i in range(1, count)], 10000)).first()[0] or []
    cuts = sorted(set(cuts))
    ranges = zip([None, *cuts], [*cuts, None], strict=True)
    return [texts.where((F.lit(True) if lo is None else F.col("doc") >= lo) & (F.lit(True) if hi is None else F.col("doc") < hi)) for lo, hi in ranges]


def removed(docs: DataFrame, window: int = 20, batches: int = 3, fanout: int = 1, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, rest (the carried columns), text, n_words, n_removed, kept_sha256 (of the kept words, joined by one space).

    text is the document's as it was if it keeps all its words, else the kept words, joined by one space.

    A word goes if a window of that many consecutive words covers it whose words also start earlier (smaller id, or the
    same document further ahead), as the input has them. The documents come in batches by ascending id, and each batch
    is merged with the index of those before. Null and empty texts have no words; texts shorter than a window keep all;
    a null id counts as the largest; rows that repeat id and text get the same result; an empty table gives an empty one.
    """
    index = Index(docs.sparkSession, None, window, fanout)
    kind = index.kind
    rows, texts = repeats.keyed(docs, id_col, text_col, carry)
    parts = batches_by_id(texts, batches)
    try:
        spans = repeats.union([index.add(part, last=part is parts[-1]) for part in parts])
    finally:
        index.delete()
    out = pa.schema([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("doc_id", pa.int64())])

    def run(batches):
        for given in batches:
            for batch in slices([given], kind.chunk):
                got = []
                for text, found in zip(batch.column("text"), batch.column("spans"), strict=True):
                    whole = text.as_buffer().to_pybytes()
                    words = whole.split()
                    starts, stops = repeats.covered(len(words), found)
                    kept = b" ".join(w for a, b in zip([0, *stops.tolist()], [*starts.tolist(), len(words)], strict=True) for w in words[a:b])
                    got.append((len(words), int((stops - starts).sum()), hashlib.sha256(kept).hexdigest(), (kept if len(starts) else whole).decode()))
                columns = list(zip(*got, strict=True))
                made = record_batch(pa.schema(list(out)[:4]), *columns)
                yield pa.RecordBatch.from_arrays([*made.columns, batch.column("id"), batch.column("rest")], names=[*out.names, "rest"])

    kind_of_rest = dict(rows.dtypes)["rest"]
    return repeats.with_spans(rows, spans).mapInArrow(lean(run), f"n_words long, n_removed long, kept_sha256 string, text string, doc_id long, rest {kind_of_rest}")
