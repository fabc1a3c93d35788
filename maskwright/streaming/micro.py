"""The same plan over streams: stateless redaction, and a memo that is kept from batch to batch."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.operators import memo
from maskwright.plans import pipeline
from maskwright.sources import tables
from maskwright.storage import shared_folder


def redact_stream(paragraphs: DataFrame, config: pipeline.Config) -> DataFrame:
    """paragraphs may be a stream: every paragraph is redacted by itself, as a batch would without a memo."""
    if config.use_memo and memo.reachable(config):
        raise ValueError("a memo needs state: use recall_stream")
    return pipeline.redact(paragraphs, config)


def stored(stream: DataFrame) -> DataFrame:
    """What a stream gives until its source is read up, as a table in the shared folder."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/progress").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def source(spark: SparkSession, path: str) -> DataFrame:
    """The table at path, a file or a folder, as a stream."""
    # a stream's source is a folder or a pattern; this pattern is met by the path alone
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def redact_files(spark: SparkSession, path: str, config: pipeline.Config) -> DataFrame:
    """Streams the documents under path through the plan into a table, once, and returns it: (doc_id, seq, n_entities, redacted_text)."""
    done = redact_stream(tables.lines(source(spark, path).select("doc_id", "text")), config)
    return stored(done.select("doc_id", "seq", F.size("resolved").alias("n_entities"), "redacted_text"))


def recall_stream(analysed: DataFrame, least: float = 0.95) -> DataFrame:
    """analysed (doc_id long, seq int, text, candidates), a stream -> (doc_id, seq, resolved), each document's memo being its state.

    A paragraph counts as later than those of earlier batches; inside a batch the order is by seq. Documents stay in the
    state until they are dropped with it.
    """
    state_schema, out = "names array<string>, kinds array<string>", f"doc_id long, seq int, resolved {T.ENTITIES}"

    def fold(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        names, kinds = state.get if state.exists else ([], [])
        known = dict(zip(names, kinds, strict=True))
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        kept = []
        for text, found in zip(rows["text"], rows["candidates"], strict=True):
            resolved = memo.resolve_list(memo.recalled(known, text or "", [dict(e) for e in found]))
            known |= memo.learnt(resolved, least)
            kept.append(resolved)
        state.update((list(known), list(known.values())))
        yield pd.DataFrame({"doc_id": key[0], "seq": rows["seq"].to_numpy(), "resolved": kept})

    return analysed.select("doc_id", "seq", "text", "candidates").groupBy("doc_id").applyInPandasWithState(fold, out, state_schema, "append", "NoTimeout")
