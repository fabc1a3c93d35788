import os

import pytest
from pyspark.sql import functions as F

from maskwright.plans import pipeline
from maskwright.sources import docx, packages


def files(spark, rows, parts=3):
    return spark.createDataFrame(rows, "path string, content binary").repartition(parts)


def names(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, fs in os.walk(folder) for f in fs if not f.endswith(".crc"))


def content(*paragraphs):
    return bytearray(docx.plain_package(paragraphs))


def test_written_redacted_and_read(spark, tmp_path):
    packages.register(spark)
    folder = str(tmp_path / "in")
    rows = [(f"a{i % 3}/d{i}.docx", content(["Write to ", f"x{i}@y", ".org"], [f"nothing {i} ", "\x01 \t & < é😀\n"], [" "])) for i in range(10)]
    files(spark, rows).write.format("docx").mode("append").save(folder)
    assert names(folder) == sorted(r[0] for r in rows)
    read = spark.read.format("docx").option("bytesPerPartition", 2500).load(folder)
    assert read.rdd.getNumPartitions() > 2 and read.count() == 20
    got = {(r.doc_id, r.seq): r for r in read.collect()}
    assert got["a1/d1.docx", 1].text == "nothing 1 � \t & < é😀\n" and [x.text for x in got["a0/d3.docx", 0].runs] == ["Write to ", "x3@y", ".org"]
    plain = docx.paragraphs(docx.read(spark, f"{folder}/*"))
    assert sorted(r.text for r in plain.collect()) == sorted(r.text for r in got.values())
    one = spark.read.format("docx").load(f"file:{folder}/a0/d0.docx")
    assert {r.doc_id for r in one.collect()} == {"d0.docx"}
    # redacted in their place
    done = pipeline.redact(read).select("doc_id", "seq", "redacted_runs")
    new = docx.rewritten(files(spark, rows), done)
    new.write.format("docx").mode("overwrite").save(str(tmp_path / "out"))
    after = spark.read.format("docx").load(str(tmp_path / "out"))
    assert after.where(F.col("text").rlike(r"x\d@y\.org")).count() == 0 and after.where("text LIKE 'Write to %@example.com'").count() == 10


def test_modes_and_refusals(spark, tmp_path):
    packages.register(spark)
    folder = str(tmp_path / "docs")
    put = lambda rows, mode: files(spark, rows).write.format("docx").mode(mode).save(folder)
    put([("a.docx", content(["a"])), ("b.docx", content(["b"]))], "append")
    with pytest.raises(Exception, match="there already"):
        put([("b.docx", content(["c"])), ("c.docx", content(["c"]))], "append")
    for bad in ([("x.docx", content(["1"])), ("x.docx", content(["2"]))], [("../x.docx", content(["1"]))], [(None, content(["1"]))], [("x.docx", None)], [("x.txt", content(["1"]))]):
        with pytest.raises(Exception, match="one path|below the folder|null"):
            put([("good.docx", content(["g"])), *bad], "append")
    assert names(folder) == ["a.docx", "b.docx"] and os.listdir(folder).__len__() == 2
    assert [r.text for r in spark.read.format("docx").load(folder).orderBy("doc_id").collect()] == ["a", "b"]
    put([("b.docx", content(["new"]))], "overwrite")
    assert names(folder) == ["b.docx"]
    put([], "append")
    assert [r.text for r in spark.read.format("docx").load(folder).collect()] == ["new"]
    put([], "overwrite")
    assert names(folder) == [] and spark.read.format("docx").load(folder).count() == 0
    with pytest.raises(ValueError, match="path"):
        packages.Documents({"path": folder}).writer(spark.range(1).schema, False)
    with pytest.raises(Exception):
        spark.read.format("docx").load(str(tmp_path / "absent")).count()


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    packages.register(spark)
    folder = str(tmp_path / "docs")
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("d"), "id", F.lit(".docx")).alias("path"), F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.lit(bytes(content(["t"])))).cast("binary").alias("content"))
    with pytest.raises(Exception, match="lost"):
        rows.write.format("docx").mode("append").save(folder)
    assert names(folder) == [] and (not os.path.isdir(folder) or os.listdir(folder) == [])


def test_broken_files(spark, tmp_path):
    packages.register(spark)
    (tmp_path / "good.docx").write_bytes(content(["g"]))
    (tmp_path / "bad.docx").write_bytes(b"no package")
    (tmp_path / "_hidden.docx").write_bytes(b"")
    with pytest.raises(Exception, match="bad.docx can't be read"):
        spark.read.format("docx").load(str(tmp_path)).count()
    assert [r.text for r in spark.read.format("docx").option("skipBroken", "true").load(str(tmp_path)).collect()] == ["g"]


def test_a_document_is_parsed_once_and_packing_is_spread(spark, monkeypatch):
    rows = spark.range(30).selectExpr("concat('d', id % 3, '.docx') AS path", "id AS seq", "array('a') AS texts")
    assert "REPARTITION_BY_NUM" in docx.packed(rows)._jdf.queryExecution().executedPlan().toString()
    seen, plain = [], docx.run_text
    monkeypatch.setattr(docx, "run_text", lambda run: (seen.append(run), plain(run))[1])
    (batch,) = docx.batches_of("x.docx", bytes(content(["a & ", "b"], ["<c>"], [" "], ["d", "", "e\n"])))
    assert len(seen) == 7
    assert [(r["seq"], r["text"], [(x["run_index"], x["text"]) for x in r["runs"]]) for r in batch.to_pylist()] == [(0, "a & b", [(0, "a & "), (1, "b")]), (1, "<c>", [(0, "<c>")]), (2, "de\n", [(0, "d"), (1, ""), (2, "e\n")])]
    monkeypatch.setattr(docx, "_BATCH", 2)
    assert [b.column("seq").to_pylist() for b in docx.batches_of("x.docx", bytes(content(["a"], ["b"], ["c"])))] == [[0, 1], [2]]
    assert docx.batches_of("x.docx", bytes(content([" "]))) == []
