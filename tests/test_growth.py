"""What keeps work from growing faster than its input: tables read once, results worked out once, tests that most texts fail first."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions import text as T
from maskwright.operators import audit, detect, measure, memo, resolve, tagger
from maskwright.plans import corpus, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
def test_derived_lines_read_customers_once(spark):
    rows = corpus.derived(spark, DATA)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "REPARTITION_BY_NUM" in plan
    spark.read.parquet(f"{DATA}/customer.parquet").createOrReplaceTempView("growth_customer")
    want = spark.sql(corpus.derived_sql("growth_customer")).collect()
    assert {(r.doc_id, r.kind, r.header_text, r.text) for r in rows.collect()} == {(r.line_id, r.kind, r.header_text, r.text) for r in want}


def _puts(monkeypatch, module):
    names, put = [], module.Tables.put
    monkeypatch.setattr(module.Tables, "put", lambda self, df, name: (names.append(name), put(self, df, name))[1])
    return names


def test_audit_and_failures_are_worked_out_once(spark, tmp_path, monkeypatch):
    names = _puts(monkeypatch, audit)
    one = F.array(T.entity(F.lit("ab"), "EMAIL", F.lit(0), F.lit(2), 0.9, "m"))
    replaced = F.transform(one, lambda e: F.struct(*[e[c].alias(c) for c in ("text", "entity_type", "start", "end", "confidence", "detector", "ord")], F.lit("xy").alias("replacement")))
    rows = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(0).alias("seq"), F.lit("ab").alias("text"), replaced.alias("replaced"), F.lit("xy").alias("redacted_text"))
    report = audit.audit(rows, rows.select("doc_id", "seq", F.when(F.col("doc_id") == 0, "ab").otherwise("xy").alias("actual_text")))
    assert [tuple(r) for r in report.by_category.select("category", "total", "survived").collect()] == [("EMAIL", 3, 1)]
    report.write(str(tmp_path / "audit"))
    assert names.count("pairs") == 1 and spark.read.json(str(tmp_path / "audit/surviving")).count() == 1
    gold = spark.createDataFrame([(1, 0, "ab", [("SSN", "zz")]), (2, 0, "ab", [("EMAIL", "ab")])], "doc_id long, seq int, text string, entities array<struct<type:string,text:string>>")
    measure.write_failures(measure.evaluated(gold.withColumn("resolved", one)), str(tmp_path / "failures"))
    assert names.count("outcomes") == 1
    assert [spark.read.json(str(tmp_path / f"failures/{k}")).count() for k in ("false_positives", "false_negatives")] == [1, 1]


def test_gates_leave_nothing_out(spark):
    for terms, parts in ((V.PERSON_LIST_TRIGGERS, V.PERSON_LIST_PARTS), (V.ORGANISATION_TRIGGERS, V.ORGANISATION_PARTS)):
        assert all(any(p in t for p in parts) for t in terms) and len(parts) < len(terms)
    texts = ["Host 10.0.0.1 on 01/02/1999", "٠١/٠٢/١٩٩٩ at", "no digit, a@b.org", "", None]
    found = spark.createDataFrame([(t,) for t in texts], "text string").select(F.size(detect.detect(F.col("text"))).alias("n"), F.size(detect.dates(F.col("text"))).alias("d")).collect()
    assert [r.n for r in found] == [2, 1, 1, 0, 0] and [r.d for r in found] == [1, 1, 0, 0, 0]


def test_tagger_encodes_a_piece_once():
    texts = ["Asha Rao came", "", "no one", "They saw Dev Shah, twice", "x"] * 9
    every = tagger.encoded(texts)
    for at in range(0, len(texts), 7):
        want, got = tagger.encoded(texts[at : at + 7]), every.part(at, at + 7)
        assert all(np.array_equal(getattr(want, f), getattr(got, f)) for f in ("features", "starts", "lengths")) and want.spans == got.spans
    assert tagger.gold_tags("Rao Rao.Rao Raoul", [("PERSON", "Rao")]) == [1, 1, 0, 1, 0]


def test_equal_lines_are_learnt_from_as_one(monkeypatch):
    """What comes out is that of the lines written out, but a line that is there very often isn't tagged once for each block of its copies."""
    lines = [("Asha Rao came", [("PERSON", "Asha Rao")]), ("", []), ("nothing of note", []), ("They saw Dev Shah in Pune", [("PERSON", "Dev Shah")]), ("Dev Shah of Pune", [("PHYSICAL_OR_MAILING_ADDRESS", "Pune")])]
    copies, calls, plain = [40, 1, 5000, 33, 3000], [], tagger.viterbi
    monkeypatch.setattr(tagger, "viterbi", lambda lines, weights: (calls.append(len(lines.lengths)), plain(lines, weights))[1])
    weights = np.random.default_rng(3).standard_normal((tagger.ROWS, tagger.N))
    every = [x for x, n in zip(lines, copies, strict=True) for _ in range(n)]
    want = tagger.learnt_from([t for t, _ in every], [tagger.gold_tags(t, g) for t, g in every], weights)
    calls.clear()
    got = tagger.learnt_from([t for t, _ in lines], [tagger.gold_tags(t, g) for t, g in lines], weights, copies)
    assert got[2] == want[2] == -(-sum(copies) // tagger.BLOCK) and all(np.array_equal(a, b) for a, b in zip(got[:2], want[:2], strict=True))
    assert len(calls) < 60 and max(calls) < len(lines)


def test_gold_is_kept_as_different_lines_in_many_tasks(spark, monkeypatch):
    dealt, frames, put = [], [], tagger.Tables.put
    monkeypatch.setattr(tagger.Tables, "put", lambda self, df, name: (frames.append(put(self, df, name)), frames[-1])[1])
    frame = type(spark.range(1))
    repartition = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *cols: (dealt.append(n), repartition(self, n, *cols))[1])
    gold = spark.range(400).selectExpr("id AS doc_id", "0 AS seq", "concat('Asha Rao came ', id % 3) AS text", "array(named_struct('type', 'PERSON', 'text', 'Asha Rao')) AS entities")
    tagger.train(gold, rounds=0)
    assert dealt == [8] and sorted(r.n for r in frames[0].collect()) == [133, 133, 134]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
def test_candidates_are_dealt_as_numbers_and_listed_where_they_lie(spark):
    for query in (queries.resolve_overlaps, queries.resolve_detectors):
        plan = query(spark, DATA)._jdf.queryExecution().executedPlan().toString()
        shuffles = [line for line in plan.splitlines() if "Exchange" in line]
        assert len(shuffles) == 1 and "REPARTITION_BY_NUM" in shuffles[0] and plan.index("collect_list") < plan.index("Exchange")


def test_what_resolution_keeps_is_in_order(spark):
    rng = np.random.default_rng(8)
    kinds, rows = ("EMAIL", "PERSON", "DIN"), []
    for i in range(300):
        starts = rng.integers(0, 6, rng.integers(0, 9)).tolist()
        rows.append((i, [("x", kinds[rng.integers(3)], a, a + int(rng.integers(1, 5)), float(rng.integers(1, 4)), f"d{k}", k) for k, a in enumerate(starts)]))
    df = spark.createDataFrame(rows, f"id int, es {T.ENTITIES}")
    for r in df.select("es", resolve.resolve(F.col("es")).alias("kept")).collect():
        assert [k.asDict() for k in r.kept] == memo.resolve_list([e.asDict() for e in r.es])
