import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from maskwright.functions import text as T
from maskwright.operators import names
from maskwright.plans import oracle, pipeline
from maskwright.plans import queries as engine
from maskwright.sources import tables
from maskwright.streaming import micro

DATA = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")


def plain(value):
    return round(value, 9) if isinstance(value, float) and math.isfinite(value) else value


@needs_data
@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    got = engine.queries()[name](spark, DATA)
    want = con.execute(oracle.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(map(plain, r))) for r in want.fetchall())


@needs_data
def test_entry_and_rows_only_queries(spark):
    assert entry.entry(spark).count() > 0
    for name in set(engine.queries()) - set(oracle.oracle_sql()):
        assert engine.queries()[name](spark, DATA).limit(5).count() > 0, name


def test_without_the_training_data_operators():
    code = "import sys; sys.modules['maskwright.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'redact_documents' in q and not any(k.startswith('op1_') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_memo_over_a_stream(spark, tmp_path):
    config = pipeline.Config(name_provider=names.ListProvider(people=["Asha Rao"]), use_memo=False)
    schema = "doc_id long, seq int, text string, header_text string"
    first = [(1, 0, "see Asha Raoul", None), (1, 1, "Asha Rao", "Full Name"), (2, 0, "Asha Rao", "Notes")]
    second = [(1, 2, "see Asha Rao now", None), (2, 1, "see Asha Rao now", None)]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        os.utime(tmp_path / f"in/{i}", (i + 1, i + 1))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = micro.recall_stream(pipeline.candidates(stream, config))
    run = out.writeStream.format("memory").queryName("recalled").option("checkpointLocation", str(tmp_path / "progress")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r.doc_id, r.seq): [(e.text, e.confidence) for e in r.resolved] for r in spark.table("recalled").collect()}
    assert got[1, 1] == [("Asha Rao", 0.95)] and got[1, 0] == [] and got[2, 0] == [("Asha Rao", 0.7)]
    assert got[1, 2] in ([("Asha Rao", 0.99)], [("Asha Rao", 0.7)]) and got[2, 1] == [("Asha Rao", 0.7)]


def test_streams_refuse_a_memo_without_state(spark):
    with pytest.raises(ValueError, match="state"):
        micro.redact_stream(spark.range(1), pipeline.Config(name_provider=names.ListProvider()))


def test_sources(spark):
    docs = spark.createDataFrame([(1, "a\n \n\nb@c.de"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.seq, r.text) for r in tables.lines(docs).collect()] == [(1, 0, "a"), (1, 3, "b@c.de")]
    pages = spark.createDataFrame([(1, "u", "<p>x &amp; y@z.org</p><script>a@b.cd</script><b>q</b>")], "page_id long, url string, html string")
    assert [r.text.strip() for r in tables.page_lines(pages).collect()] == ["x & y@z.org", "q"]
    cells = tables.cells(spark.createDataFrame([(1, "01/02/1990", 7)], "id long, dob string, n int"), "id")
    got = pipeline.entities(pipeline.analyse(cells)).collect()
    assert [(r.header_text, r.entity_type) for r in got] == [("dob", "DATE_OF_BIRTH")]


def test_a_detector_of_ones_own(spark):
    whole = lambda text: F.when(text.startswith("#"), F.array(T.entity(text, "TAG", F.lit(0), F.length(text), 0.9, "tags"))).otherwise(T.no_entities())
    df = spark.createDataFrame([("d", 0, "#x", None)], "doc_id string, seq int, text string, header_text string")
    assert pipeline.redact(df, pipeline.Config(detectors=(whole,))).first().redacted_text == "[REDACTED TAG]"
