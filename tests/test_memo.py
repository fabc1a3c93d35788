"""The memo by repeated joins against a fold over one paragraph after another."""

import random

import pytest
from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.operators import memo, resolve

FIELDS = ("text", "entity_type", "start", "end", "confidence", "detector", "ord")
SCHEMA = f"doc_id string, seq int, text string, candidates {T.ENTITIES}, note string"
NAMES = ["Asha Rao", "Asha Rao Iyer", "Rao Iyer", "Iyer Foods Co", "Dev Shah", "Shah Asha Rao", r"A.B (x) \E[c", "Établi Ñandú", "the company", "Solo"]


def folded(rows, least, scope):
    """{key: (candidates, resolved)} of rows (doc, seq, text, candidates, note) in their order."""
    docs, out = {}, {}
    for row in sorted(rows, key=lambda r: 1 << 40 if r[1] is None else r[1]):
        docs.setdefault(row[0], []).append(row)
    for doc, mine in docs.items():
        known = {}
        plain = [[dict(zip(FIELDS, e, strict=True)) for e in r[3]] for r in mine]
        if scope == "document" and doc is not None:
            for found in plain:
                known |= memo.learnt(memo.resolve_list(found), least)
        for row, found in zip(mine, plain, strict=True):
            pool = memo.recalled(known, row[2] or "", found)
            kept = memo.resolve_list(pool)
            if scope == "forward" and doc is not None:
                known |= memo.learnt(kept, least)
            out[row[4]] = pool, kept
    return out


def paragraphs(seed, n_docs=8, n=30):
    rng = random.Random(seed)
    rows = []
    for d in range(n_docs):
        for s in range(n):
            parts = []
            for _ in range(rng.randint(0, 4)):
                parts += [rng.choice(NAMES), rng.choice([" and ", ", ", "x ", " ", " ", "-", ". "])]
            text = "".join(parts)
            found = []
            for name in NAMES:
                at = text.find(name)
                while at >= 0:
                    if rng.random() < 0.3:
                        more = rng.choice([0, 0, 0, 3])
                        end = min(len(text), at + len(name) + more)
                        found.append((text[at:end], rng.choice(["PERSON", "PERSON", "COMPANY", "EMAIL"]), at, end, rng.choice([0.7, 0.92, 0.95, 0.995]), rng.choice("pq"), 0))
                    at = text.find(name, at + 1)
            rng.shuffle(found)
            found = [(*e[:6], i) for i, e in enumerate(found)]
            rows.append((None if d == 3 else f"d{d}", s * 2 if d != 5 or s else None, None if d == 1 and s == 4 else text, found, f"{d}/{s}"))
    return rows


@pytest.mark.parametrize("scope", ["forward", "document"])
def test_against_a_fold(spark, scope):
    changed = 0
    for seed in (1, 2):
        rows = paragraphs(seed)
        df = spark.createDataFrame(rows, SCHEMA).coalesce(1).withColumn("resolved", T.once(resolve.resolve(F.col("candidates")))).withColumn("a.b", F.lit(7))
        got = memo.recall(df, 0.95, scope)
        assert got.columns == df.columns
        want = folded(rows, 0.95, scope)
        found = got.collect()
        assert len(found) == len(rows)
        for r in found:
            candidates, kept = want[r.note]
            assert [e.asDict() for e in r.candidates] == candidates, r.note
            assert [e.asDict() for e in r.resolved] == kept, r.note
            assert r["a.b"] == 7
            changed += len(r.candidates) != len([x for x in rows if x[4] == r.note][0][3])
    assert changed > 40


def test_names_that_depend_on_each_other(spark):
    """A name that the memo drives out no longer enters it, so what depends on it changes too, for paragraph after paragraph."""
    e = lambda text, name, kind, confidence: (name, kind, text.index(name), text.index(name) + len(name), confidence, "m", 0)
    texts = ["Asha Rao came", "Asha Rao Iyer wrote", "Rao Iyer Foods sold", "Iyer Foods Works rose", "Foods Works Dev fell"]
    found = [[e(texts[0], "Asha Rao", "PERSON", 0.96)], [e(texts[1], "Rao Iyer", "PERSON", 0.97)], [e(texts[2], "Iyer Foods", "COMPANY", 0.98)], [e(texts[3], "Foods Works", "COMPANY", 0.97)], [e(texts[4], "Works Dev", "PERSON", 0.96)]]
    rows = [("d", i, t, f, str(i)) for i, (t, f) in enumerate(zip(texts, found, strict=True))]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("resolved", resolve.resolve(F.col("candidates")))
    want = folded(rows, 0.95, "forward")
    got = {r.note: r for r in memo.recall(df).collect()}
    assert all([x.asDict() for x in got[k].resolved] == want[k][1] for k in want)


def test_one_large_document_and_no_python(spark):
    n = 3000
    rows = spark.range(n).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("seq"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("Asha Rao met us on day "), "id")).otherwise(F.lit("nothing at all")).alias("text"))
    one = F.when(F.col("seq") == 3, F.array(T.entity(F.lit("Asha Rao"), "PERSON", F.lit(0), F.lit(8), 0.95, "m"))).otherwise(T.no_entities())
    df = rows.withColumn("candidates", one).repartition(8).withColumn("resolved", F.col("candidates"))
    got = memo.recall(df)
    assert got.where(F.size("resolved") > 0).count() == n // 3 - 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    empty = memo.recall(df.where("seq < 0"))
    assert empty.count() == 0 and empty.columns == df.columns
    with pytest.raises(ValueError):
        memo.recall(df, scope="backwards")


def test_nothing_goes_through_the_driver(spark, monkeypatch):
    """Alike texts make small files of many rows: what Spark takes for small must not be broadcast."""
    plans = []
    put = memo.Tables.put

    def kept(self, df, name):
        plans.append(df)
        return put(self, df, name)

    monkeypatch.setattr(memo.Tables, "put", kept)
    rows = paragraphs(1)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("resolved", T.once(resolve.resolve(F.col("candidates"))))
    got = memo.recall(df)
    assert got.count() == len(rows) and len(plans) > 4
    assert all("Broadcast" not in p._jdf.queryExecution().executedPlan().toString() for p in (*plans, got))
