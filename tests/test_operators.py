import random
import sys

import pytest
from pyspark.sql import functions as F

from maskwright import vocab as V
from maskwright.functions import pseudonym
from maskwright.functions import text as T
from maskwright.operators import memo, names, refine, resolve
from maskwright.plans import pipeline

PARAGRAPH = "doc_id string, seq int, text string, header_text string"


def found(spark, texts, config=pipeline.Config(), header=None):
    rows = spark.createDataFrame([("d", i, t, header) for i, t in enumerate(texts)], PARAGRAPH)
    out = {i: [] for i in range(len(texts))}
    for r in pipeline.entities(pipeline.analyse(rows, config)).orderBy("seq", "start").collect():
        out[r.seq].append((r.entity_type, r.text, r.confidence))
    return [out[i] for i in range(len(texts))]


def test_numbers_by_their_context(spark):
    got = found(spark, [
        "Call me at +91 98765 43210 today", "Aadhaar 2345 6789 0123 is mine", "financial year total 9876543210", "Paid by card 2345 6789 0123", "My DIN is 01234567.", "phone 022-12345678 office",
        "SSN 123-45-6789, not 000-12-3456 nor 666-12-3456", "Card 4111 1111 1111 1111 ok", "Card 4111 1111 1111 1112 bad", "Born on 01.02.1990 in Pune", "Meeting on 01/02/2020", "Server 10.0.0.255 and 256.1.1.1", "Mail a.b+c@x-y.co.in now", "order 9876543210",
    ])
    kinds = [[k for k, *_ in x] for x in got]
    assert kinds == [["PHONE"], ["AADHAAR"], [], [], ["DIN"], ["PHONE"], ["SSN"], ["CREDIT_CARD"], [], ["DATE_OF_BIRTH"], [], ["IP_ADDRESS"], ["EMAIL"], []]
    assert got[1][0][2] == V.CONTEXT and got[5][0][1] == "022-12345678" and got[12][0][1] == "a.b+c@x-y.co.in"


def test_headers(spark):
    assert found(spark, ["01/02/1990"], header="Date of Birth") == [[("DATE_OF_BIRTH", "01/02/1990", V.TABLE_HEADER)]]
    assert found(spark, ["01/02/1990"], header="Shipped") == [[]]


def test_addresses(spark):
    got = found(spark, ["Registered office: 12 Market Road, Pune 411001", "Address: short", "  12, Hill Road, Pune 411001 ", "Pune 411001, far", "Email address foo address: 1 Long Lane, Agra"])
    assert [[(k, t) for k, t, _ in x] for x in got] == [
        [("PHYSICAL_OR_MAILING_ADDRESS", "12 Market Road, Pune 411001")], [], [("PHYSICAL_OR_MAILING_ADDRESS", "12, Hill Road, Pune 411001")], [], [("PHYSICAL_OR_MAILING_ADDRESS", "foo address: 1 Long Lane, Agra")],
    ]


def test_people_and_companies(spark):
    got = found(spark, [
        "our KMPs including Asha Rao and Vikram Shah Mehta", "Executive Directors: none", "appointed by The Blue Hill Partners in May", "Acme Foods Private Limited agreed", "TechCorp Inc. signed", "Kirtane & Pandit LLP audited", "Asha Rao met Vikram Shah", "Delta Corp.x",
    ])
    assert [[(k, t) for k, t, _ in x] for x in got] == [
        [("PERSON", "Asha Rao"), ("PERSON", "Vikram Shah Mehta")], [], [("COMPANY", "Blue Hill Partners")], [("COMPANY", "Acme Foods Private Limited")], [], [("COMPANY", "Pandit LLP")], [], [("COMPANY", "Delta Corp.")],
    ]
    relaxed = found(spark, ["TechCorp Inc. signed"], pipeline.Config(strict_company_end=False))
    assert relaxed == [[("COMPANY", "TechCorp Inc.", V.CONTEXT)]]


@pytest.mark.parametrize(
    ("kind", "text", "header", "around", "want"),
    [
        ("COMPANY_CANDIDATE", "Zeta LLC", None, "Zeta LLC won", ("COMPANY", 0.92)),
        ("COMPANY_CANDIDATE", "Zeta", None, "Company: Zeta", ("COMPANY", 0.92)),
        ("COMPANY_CANDIDATE", "Equity Offer", "Company", "Equity Offer", ("COMPANY", 0.95)),
        ("COMPANY_CANDIDATE", "Equity Ltd", None, "Equity Ltd", None),
        ("ADDRESS_CANDIDATE", "Pune", None, "Pune", None),
        ("ADDRESS_CANDIDATE", "Pune", "Address", "Pune", ("PHYSICAL_OR_MAILING_ADDRESS", 0.95)),
        ("ADDRESS_CANDIDATE", "Pune", None, "situated at Pune", ("PHYSICAL_OR_MAILING_ADDRESS", 0.92)),
        ("PERSON", "Asha Rao", None, "Asha Rao came", ("PERSON", 0.70)),
        ("PERSON", "Asha", None, "Asha came", None),
        ("PERSON", "Asha", None, "Dr. Asha came", ("PERSON", 0.92)),
        ("PERSON", "Log Ip", None, "Log Ip 1.2.3.4", None),
        ("PERSON", "PAN Number", None, "Mr. PAN Number", None),
        ("PERSON", "Asha Rao", "Full Name", "Asha Rao", ("PERSON", 0.95)),
        ("PERSON", "Asha Rao", "Name of Director", "Asha Rao", ("PERSON", 0.92)),
        ("DATE", "1/1/90", "DOB", "1/1/90", ("DATE_OF_BIRTH", 0.95)),
    ],
)
def test_refinement(spark, kind, text, header, around, want):
    row = spark.createDataFrame([(around, header, text, kind)], "text string, header_text string, t string, k string")
    row = row.withColumn("candidates", F.array(T.entity(F.col("t"), F.col("k"), F.lit(0), F.length("t"), 0.7, "names")))
    got = refine.refine(row).first().refined
    assert [(e.entity_type, e.confidence) for e in got] == ([want] if want else [])


def test_resolution_against_a_loop(spark):
    rng = random.Random(5)
    kinds = [*V.PRIORITY, "OTHER"]
    cases = []
    for _ in range(300):
        case = []
        for i in range(rng.randint(0, 8)):
            a = rng.randint(0, 12)
            case.append(("x", rng.choice(kinds), a, a + rng.randint(1, 6), rng.choice([0.7, 0.85, 0.92, 0.95]), rng.choice("pqr"), i))
        cases.append((len(cases), case))
    df = spark.createDataFrame(cases, f"i int, es {T.ENTITIES}").repartition(4)
    for r in df.select("i", resolve.resolve(F.col("es")).alias("kept")).collect():
        names_ = ("text", "entity_type", "start", "end", "confidence", "detector", "ord")
        want = memo.resolve_list([dict(zip(names_, e, strict=True)) for e in cases[r.i][1]])
        assert [e.asDict() for e in r.kept] == want
        assert all(a.end <= b.start for a, b in zip(r.kept, r.kept[1:], strict=False))


def test_priority_and_evictions(spark):
    def run(*es):
        df = spark.createDataFrame([([("x", k, a, b, c, "t", i) for i, (k, a, b, c) in enumerate(es)],)], f"es {T.ENTITIES}")
        return [(e.entity_type, e.start, e.end) for e in df.select(resolve.resolve(F.col("es")).alias("r")).first().r]

    assert run(("DIN", 0, 8, 0.85), ("PHONE", 0, 12, 0.85)) == [("PHONE", 0, 12)]
    assert run(("PERSON", 0, 5, 0.9), ("COMPANY", 5, 9, 0.9)) == [("PERSON", 0, 5), ("COMPANY", 5, 9)]
    assert run(("PERSON", 0, 4, 0.9), ("PERSON", 3, 8, 0.95), ("PERSON", 7, 9, 0.99)) == [("PERSON", 7, 9)]


def test_replacements(spark):
    kinds = [*V.ENTITY_TYPES, "DATE", "ODD"]
    rows = [(t, k) for k in kinds for t in ("John Doe", "JOHN DOE", "x")]
    df = spark.createDataFrame(rows, "t string, k string").select("t", "k", pseudonym.replacement(F.col("t"), F.col("k")).alias("r"), pseudonym.seed_number(F.col("t"), F.col("k")).alias("s"))
    got = {(r.t, r.k): (r.r, r.s) for r in df.collect()}
    shapes = {"EMAIL": r"\S+@example\.com", "PHONE": r"\+91 \d{10}", "SSN": r"\d{3}-\d{2}-\d{4}", "DATE_OF_BIRTH": r"\d{4}-\d\d-\d\d", "AADHAAR": r"\d{4} \d{4} \d{4}", "DIN": r"\d{8}", "ODD": r"\[REDACTED ODD\]", "CREDIT_CARD": r"\d{16}", "IP_ADDRESS": r"(\d{1,3}\.){3}\d{1,3}"}
    import re

    for k in kinds:
        assert got["John Doe", k] == got["JOHN DOE", k]
        assert re.fullmatch(shapes.get(k, ".+"), got["x", k][0])
    assert got["John Doe", "PERSON"][1] == 2683854519
    card = got["x", "CREDIT_CARD"][0]
    assert spark.range(1).select(T.luhn(F.lit(card)).alias("ok")).first().ok


def test_rewriting_runs_against_a_loop(spark):
    rng = random.Random(8)
    cases = []
    for i in range(200):
        runs = ["".join(rng.choice("abc é🙂") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 5))]
        n, at, spans = len("".join(runs)), 0, []
        while at < n and rng.random() < 0.8:
            a = rng.randint(at, n - 1)
            b = rng.randint(a + 1, n)
            spans.append((a, b, rng.choice(["", "X", "LONGER"])))
            at = b
        if rng.random() < 0.2:
            spans.append((n, n + 2, "OUT"))
        cases.append((i, list(enumerate(runs)), [("t", "K", a, b, 0.9, "d", j, r) for j, (a, b, r) in enumerate(spans)]))
    df = spark.createDataFrame(cases, "i int, runs array<struct<run_index:int,text:string>>, es array<struct<text:string,entity_type:string,start:int,end:int,confidence:double,detector:string,ord:int,replacement:string>>").repartition(4)
    out = df.select("i", pseudonym.redacted_runs(F.col("runs"), F.col("es")).alias("r"), pseudonym.redacted(F.concat_ws("", F.transform("runs", lambda r: r["text"])), F.col("es")).alias("t"))
    for row in out.collect():
        _, runs, es = cases[row.i]
        chars = [(c, k) for k, t in runs for c in t]
        new, skip = ["" for _ in runs], 0
        at = 0
        for _, _, a, b, _, _, _, r in es:
            if b > len(chars):
                continue
            for c, k in chars[at:a]:
                new[k] += c
            new[chars[a][1]] += r
            at = b
        for c, k in chars[at:]:
            new[k] += c
        assert [x.text for x in row.r] == new and row.t == "".join(new)


def test_memo(spark):
    person = pipeline.Config(name_provider=names.ListProvider(people=["Asha Rao"]))
    rows = [("a", 0, "Then Asha Raos and blacksmith", None), ("a", 1, "Asha Rao", "Full Name"), ("a", 2, "the Asha Rao file, Asha Raoul", None), ("b", 0, "Asha Rao", "Full Name of Director"), ("b", 1, "the Asha Rao file", None)]
    df = spark.createDataFrame(rows, PARAGRAPH)
    got = {(r.doc_id, r.seq): (r.text, r.confidence, r.detector) for r in pipeline.entities(pipeline.analyse(df, person)).collect()}
    assert got == {("a", 1): ("Asha Rao", 0.95, "spacy_ner"), ("a", 2): ("Asha Rao", 0.99, "spacy_ner,stateful_memo"), ("b", 0): ("Asha Rao", 0.92, "spacy_ner"), ("b", 1): ("Asha Rao", 0.70, "spacy_ner")}
    lower = pipeline.Config(detectors=("patterns", "context"), memo_min_confidence=0.92)
    rows = [("a", 0, "Asha Rao waits", None), ("a", 1, "KMPs including Asha Rao", None), ("a", 2, "Asha Rao left", None)]
    df = spark.createDataFrame(rows, PARAGRAPH)
    assert {r.seq for r in pipeline.entities(pipeline.analyse(df, lower)).collect()} == {1, 2}
    whole = pipeline.Config(detectors=("patterns", "context"), memo_min_confidence=0.92, memo_scope="document")
    assert {r.seq for r in pipeline.entities(pipeline.analyse(df, whole)).collect()} == {0, 1, 2}


def test_memo_keeps_every_row(spark):
    """Paragraphs that share a place, or have none, stay as many as they were, with their other columns."""
    person = pipeline.Config(name_provider=names.ListProvider(people=["Asha Rao"]))
    rows = [("a", 0, "Asha Rao", "Full Name", 1), ("a", 1, "the Asha Rao file", None, 2), ("a", 1, "an Asha Rao note", None, 3), ("a", None, "Asha Rao here", None, 4), (None, 0, "Asha Rao", "Full Name", 5), (None, 0, "the Asha Rao file", None, 6)]
    df = spark.createDataFrame(rows, PARAGRAPH + ", n int").withColumn("loc", F.struct(F.lit(1).alias("x"), F.array(F.lit("y")).alias("z")))
    done = pipeline.analyse(df, person)
    got = {r.n: r for r in done.collect()}
    assert len(got) == 6 and done.count() == 6
    assert all(r.loc.z == ["y"] for r in got.values())
    assert [[e.confidence for e in got[n].resolved] for n in (1, 2, 3, 6)] == [[0.95], [0.99], [0.99], [0.70]]
    plan = pipeline.analyse(df, person)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan  # the provider has run, once, for the table that the plan reads
    assert pipeline.analyse(df.limit(0), person).count() == 0


def test_name_model(monkeypatch):
    """What spaCy finds is taken over; without it, or without the model, nothing is found. A model never sees more than so many characters."""
    import types

    class Doc:
        def __init__(self, text):
            seen.append(len(text))
            self.ents = [types.SimpleNamespace(label_="PERSON", start_char=0, end_char=4)]

    def load(name):
        if name == "missing":
            raise OSError(name)
        return Doc

    seen = []
    monkeypatch.setitem(sys.modules, "spacy", types.SimpleNamespace(load=load))
    assert names.ModelProvider("there").load()("Asha Rao") == [("PERSON", 0, 4)]
    assert names.ModelProvider("missing").load()("Asha Rao") == ()
    monkeypatch.setitem(sys.modules, "spacy", None)
    assert names.ModelProvider().load()("Asha Rao") == ()


def test_a_model_sees_so_many_characters(spark):
    name, most = "Asha Rao", names.MOST_CHARACTERS
    texts = ["x" * (most - 9) + " " + name + " later", "x" * (most - 4) + " " + name]
    df = spark.createDataFrame([("d", i, t, "Full Name") for i, t in enumerate(texts)], PARAGRAPH)
    person = pipeline.Config(detectors=("names",), name_provider=names.ListProvider(people=[name]), use_memo=False)
    assert [[e.text for e in r.candidates] for r in pipeline.candidates(df, person).orderBy("seq").collect()] == [[name], []]


def test_intermediate_types_without_context(spark):
    only = pipeline.Config(detectors=("patterns",))
    assert found(spark, ["on 01/02/2020"], only) == [[("DATE", "01/02/2020", 0.85)]]
    assert found(spark, ["on 01/02/2020"], pipeline.Config(detectors=("patterns",), drop_intermediate=True)) == [[]]
    assert found(spark, [None, "", "  "], only) == [[], [], []]


def test_domain_sentences_stay(spark):
    texts = ["The Offer comprises equity shares of face value.", "Bids are accepted between 10.00 a.m. and 5.00 p.m.", "Section 32 of the Companies Act applies.", "The price band is 95 to 100 rupees per share.", "See page 12345 for details.", "Our Company was founded in 1999."]
    df = spark.createDataFrame([("d", i, t, None) for i, t in enumerate(texts)], PARAGRAPH)
    assert all(r.text == r.redacted_text for r in pipeline.redact(df).collect())


def test_native_plan_has_no_python(spark):
    df = spark.createDataFrame([("d", 0, "x@y.com", None)], PARAGRAPH)
    plan = pipeline.redact(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
