"""State that ends, and event time, over streams of files that come one after another."""

import os
import time

from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.streaming import expiring, windows

LINES = f"doc_id long, seq int, text string, candidates {T.ENTITIES}"


def line(doc, seq, text, seeds=True):
    found = [("Asha Rao", "PERSON", text.index("Asha Rao"), text.index("Asha Rao") + 8, 0.95, "m", 0)] if seeds and "Asha Rao" in text else []
    return doc, seq, text, found


def put(spark, folder, number, rows, schema=LINES):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{number}")
    os.utime(f"{folder}/{number}", (number + 1, number + 1))


def run(spark, folder, rows, **times):
    """What a query gives that starts from its checkpoint, if there is one, and is stopped when it has read so many rows."""
    stream = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    out = expiring.recall_stream(stream, **times).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(processingTime="200 milliseconds").start()
    until = time.time() + 60  # by the clock, state may end at any time: such a query has always another batch to look for that
    while sum(p.numInputRows for p in out.recentProgress) < rows and time.time() < until:
        time.sleep(0.2)
    out.stop()
    return {(r.doc_id, r.seq): [(e.text, e.entity_type, e.start, e.confidence) for e in r.resolved] for r in spark.read.parquet(f"{folder}/out").collect()}


def test_memo_outlives_a_restart(spark, tmp_path):
    first = [line(1, 0, "see Asha Rao", False), line(1, 1, "Asha Rao came"), line(2, 0, "nobody")]
    second = [line(1, 2, "then Asha Rao and Asha Rao", False), line(2, 1, "of Asha Rao", False), line(1, 3, "Asha Raoul", False)]
    put(spark, tmp_path / "in", 0, first)
    run(spark, tmp_path, 3)
    put(spark, tmp_path / "in", 1, second)
    got = run(spark, tmp_path, 3)
    want = {k: [] for k in ((1, 0), (2, 0), (2, 1), (1, 3))} | {(1, 1): [("Asha Rao", "PERSON", 0, 0.95)], (1, 2): [("Asha Rao", "PERSON", 5, 0.99), ("Asha Rao", "PERSON", 18, 0.99)]}
    assert got == want


def test_names_and_idle_documents_are_forgotten(spark, tmp_path):
    for kind, times in (("name", {"name_ms": 1500, "idle_ms": 3_600_000}), ("idle", {"name_ms": 3_600_000, "idle_ms": 1500})):
        folder = tmp_path / kind
        put(spark, folder / "in", 0, [line(1, 0, "Asha Rao came")])
        run(spark, folder, 1, **times)
        time.sleep(2)
        put(spark, folder / "in", 1, [line(9, 0, "something else")])
        put(spark, folder / "in", 2, [line(1, 1, "then Asha Rao", False)])
        got = run(spark, folder, 2, **times)  # in its first batch the document, of which it has nothing, ends
        assert got[1, 0] and not got[1, 1], kind


def test_late_rows_are_those_that_windows_leave_out(spark, tmp_path):
    """Three files: a row of the second is behind the first's watermark, another only out of order; the third comes after a restart."""
    schema = "ts timestamp, entity_type string"
    at = lambda s: f"2024-01-01 {s}"
    files = [[(at("10:05:00"), "EMAIL"), (at("12:30:00"), "EMAIL")], [(at("10:50:00"), "EMAIL"), (at("11:50:00"), "PHONE"), (at("13:10:00"), "EMAIL")], [(at("11:59:00"), "EMAIL"), (at("15:40:00"), "PHONE"), (None, "PHONE")]]
    frames = [spark.createDataFrame(rows, "ts string, entity_type string").select(F.col("ts").cast("timestamp").alias("ts"), "entity_type") for rows in files]
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    for i, df in enumerate(frames):
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        os.utime(f"{tmp_path}/in/{i}", (i + 1, i + 1))
        if i != 1:
            windows.write_with_late(stream(), "1 hour", "1 hour", str(tmp_path / "split")).awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/split/rows").where("ts IS NOT NULL")
    assert rows.count() == 7 and sorted(str(r.ts)[11:16] for r in rows.where("late").collect()) == ["10:50", "11:59"]
    counted = windows.by_window(stream(), "1 hour", "1 hour").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/progress").outputMode("append").trigger(availableNow=True).start()
    counted.awaitTermination()
    got = {(str(r.start)[11:13], r.entity_type): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # a stream takes a late row as long as the batch before its own hadn't closed the window
    counts = lambda df: {(str(r.start)[11:13], r.entity_type): r.n for r in windows.by_window(df, "1 hour", "1 hour").where("end <= timestamp'2024-01-01 14:40:00'").collect()}
    least, most = counts(rows.where("NOT late")), counts(rows)
    assert least == {("10", "EMAIL"): 1, ("11", "PHONE"): 1, ("12", "EMAIL"): 1, ("13", "EMAIL"): 1}
    assert set(least) <= set(got) <= set(most) and all(least.get(k, 0) <= n <= most[k] for k, n in got.items())


def test_sessions(spark):
    rows = [(f"2024-01-01 {t}", "u", k) for t, k in (("10:00:00", "EMAIL"), ("10:20:00", "EMAIL"), ("10:50:00", "PHONE"), ("12:00:00", "EMAIL"))]
    df = spark.createDataFrame(rows, "ts string, user string, entity_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = sorted((str(r.start)[11:16], str(r.end)[11:16], r.n) for r in windows.by_session(df, "30 minutes", "1 hour", "user").collect())
    assert got == [("10:00", "11:20", 3), ("12:00", "12:30", 1)]
