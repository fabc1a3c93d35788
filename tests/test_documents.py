import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwright import cli, service
from maskwright.operators import audit, measure, names
from maskwright.plans import pipeline
from maskwright.sources import docx, tables

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def p(*runs):
    return "<w:p>" + "".join(f'<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">{t}</w:t></w:r>' for t in runs) + "</w:p>"


def cell(text, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{text}</w:tc>"


def document(body, header=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ref = '<w:sectPr><w:headerReference w:type="default" r:id="h1"/></w:sectPr>' if header else ""
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {W}><w:body>{body}{ref}</w:body></w:document>')
        z.writestr("word/styles.xml", "<styles/>")
        if header:
            z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="h1" Type="t" Target="header1.xml"/></Relationships>')
            z.writestr("word/header1.xml", f"<w:hdr {W}>{header}</w:hdr>")
    return out.getvalue()


TABLE = "<w:tbl><w:tr>" + cell(p("Full Name")) + cell(p("Email")) + "</w:tr><w:tr>" + cell(p("Asha Rao")) + cell(p("asha@", "rao.org")) + "</w:tr><w:tr>" + cell(p("wide"), '<w:gridSpan w:val="2"/>') + "</w:tr></w:tbl>"
BODY = p("Write to ", "x@y", ".com please") + p(" ") + p("the Asha Rao file") + TABLE
CONTENT = document(BODY, p("Phone +91 98765 43210"))


def texts(content):
    return [x.text for x in docx.Package(content).paragraphs()]


def test_traversal():
    found = list(docx.Package(CONTENT).paragraphs())
    assert [(x.text, x.header_text, x.location.get("paragraph_index")) for x in found] == [
        ("Write to x@y.com please", None, 0), ("the Asha Rao file", None, 2), ("Full Name", "Full Name", 0), ("Email", "Email", 0), ("Asha Rao", "Full Name", 0), ("asha@rao.org", "Email", 0), ("wide", "Full Name", 0), ("Phone +91 98765 43210", None, 0),
    ]
    assert found[4].location["row_index"] == 1 and found[2].location["is_header"] and found[-1].location["is_header"]


def test_redacted_document_keeps_its_form(spark):
    out, report = service.redact_bytes(spark, CONTENT)
    after = texts(out)
    assert len(after) == len(texts(CONTENT)) and after[1] == "the Asha Rao file"
    assert after[0].endswith("@example.com please") and "x@y" not in after[0] and "98765" not in after[-1]
    assert report["stats"]["entities_replaced"] == 3 and report["entity_counts_by_type"] == {"EMAIL": 2, "PHONE": 1}
    assert report["stats"]["replacements_in_tables"] == 1 and report["stats"]["replacements_in_headers_footers"] == 1
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        assert z.read("word/styles.xml") == b"<styles/>" and b"<w:b" in z.read("word/document.xml")
    again, _ = service.redact_bytes(spark, CONTENT)
    assert texts(again) == after


def test_audit_of_paragraphs_that_share_a_place(spark):
    """Equal texts are partners, whatever a change elsewhere does to the order of texts."""
    rows = [(k, s, t) for k in (1, None) for s, t in ((0, "Mail asha@x.org now"), (0, "Mail zoe@y.org and bo@z.org now"), (0, "Plain"), (1, "Mail asha@x.org now"))]
    done = pipeline.redact(spark.createDataFrame(rows, "doc_id int, seq int, text string"))
    changed = done.select("doc_id", "seq", F.when(F.col("text").contains("zoe"), F.concat(F.lit("A"), F.substring("redacted_text", 2, 1000))).otherwise(F.col("redacted_text")).alias("actual_text"))
    totals = audit.audit(done, changed).totals.first()
    assert (totals.total, totals.survived, totals.unintended_changes) == (8, 0, 2)
    twice = changed.unionByName(changed)
    assert audit.audit(done.unionByName(done), twice).totals.first().survived == 0
    fewer = changed.where("seq = 0")
    assert audit.audit(done, fewer).totals.first().survived == 2 and audit.audit(done, fewer, "left out").totals.first().total == 6
    with pytest.raises(ValueError):
        audit.audit(done, changed, "survives")


def test_many_documents_and_audit(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"d{i}.docx").write_bytes(document(p(f"Mail u{i}@x.org and u{i}@y.org")))
    files = docx.read(spark, str(tmp_path))
    config = pipeline.Config(name_provider=names.ListProvider(people=["Asha Rao"]))
    done = pipeline.redact(docx.paragraphs(files), config)
    out = docx.rewritten(files, done)
    actual = docx.paragraphs(out).select("doc_id", "seq", F.col("text").alias("actual_text"))
    report = audit.audit(done, actual)
    assert report.totals.first().asDict() == {"total": 6, "redacted": 6, "survived": 0, "unintended_changes": 0, "coverage": 1.0}
    left = done.select("doc_id", "seq", F.concat("text", F.lit("!")).alias("actual_text"))
    report = audit.audit(done, left)
    assert report.totals.first().survived == 6 and report.by_category.first().survived == 6 and report.changes.count() >= 3
    report.write(str(tmp_path / "audit"))
    one = report.document()
    assert one["total_original_pii_candidates"] == 6 and one["redacted_candidates"] == 0 and one["by_category"] == {"EMAIL": {"total": 6, "survived": 6}}
    assert len(one["surviving_pii"]) == 6 and {"original_text", "location", "detector_source"} <= set(one["surviving_pii"][0])
    assert audit.audit(done.limit(0), actual).totals.first().coverage == 1.0


def test_audit_of_shared_and_missing_places(spark):
    rows = [("d", 0, "a@x.org", None), ("d", 0, "b@x.org", None), (None, 1, "c@x.org", None), ("d", 2, "d@x.org", None)]
    done = pipeline.redact(spark.createDataFrame(rows, "doc_id string, seq int, text string, header_text string"))
    actual = done.select("doc_id", "seq", F.when(F.col("doc_id").isNull(), F.col("text")).otherwise(F.col("redacted_text")).alias("actual_text"))
    report = audit.audit(done, actual)
    assert report.totals.first().asDict() == {"total": 4, "redacted": 3, "survived": 1, "unintended_changes": 0, "coverage": 0.75}
    assert report.surviving.first().original_text == "c@x.org"
    gone = audit.audit(done, actual.where("doc_id = 'd' and seq = 0"))
    assert gone.totals.first().survived == 2


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    source, target = tmp_path / "in.docx", tmp_path / "out.docx"
    source.write_bytes(CONTENT)
    (tmp_path / "names.json").write_text(json.dumps({"people": ["Asha Rao"]}))
    assert cli.main(["-i", str(source), "-o", str(target), "--names", "names.json"]) == 0
    assert texts(target.read_bytes())[4] != "Asha Rao"
    report = json.loads((tmp_path / "redaction_integrity_report.json").read_text())
    assert report["entity_counts_by_type"]["PERSON"] == 2 and report["integrity_violations_found"] == 0
    assert cli.main(["-i", "missing.docx", "-o", "x.docx"]) == 0
    assert cli.main(["-i", str(source), "--audit", str(target), "--names", "names.json", "--report", str(tmp_path / "report")]) == 0
    assert json.loads((tmp_path / "report" / "redaction_audit.json").read_text())["coverage"] == 1.0


def test_http(spark):
    def post(name, content, field="file"):
        body = f'--B\r\nContent-Disposition: form-data; name="{field}"; filename="{name}"\r\nContent-Type: application/octet-stream\r\n\r\n'.encode() + content + b"\r\n--B--\r\n"
        return service.answer(spark, "POST", "/redact", "multipart/form-data; boundary=B", body)

    assert service.answer(spark, "GET", "/health")[0] == 200 and service.answer(spark, "GET", "/")[0] == 200 and service.answer(spark, "GET", "/x")[0] == 404
    assert post("a.txt", b"x")[0] == 415 and post("a.docx", b"")[0] == 400 and post("a.docx", b"junk")[0] == 500
    assert post("a.docx", CONTENT, "other")[0] == 422 and service.answer(spark, "POST", "/redact")[0] == 422
    status, kind, out = post("a.docx", CONTENT)
    assert (status, kind) == (200, service.MEDIA_TYPE) and "x@y" not in texts(out)[0]


def test_evaluation(spark, tmp_path):
    gold = [
        {"text": "Mail a@b.co or c@d.co", "entities": [{"type": "EMAIL", "text": "a@b.co"}, {"type": "EMAIL", "text": "zz c@d.co"}, {"type": "PHONE", "text": "1"}]},
        {"text": "DIN 12345678", "entities": []},
        {"text": "none", "entities": [{"type": "ODD", "text": "x"}]},
    ]
    (tmp_path / "gold.json").write_text(json.dumps(gold, indent=1))
    outcomes = measure.evaluated(pipeline.analyse(tables.ground_truth(spark, str(tmp_path / "gold.json"))))
    counts = measure.category_counts(outcomes)
    rows = {r.category: r for r in measure.category_scores(counts).collect()}
    assert (rows["EMAIL"].tp, rows["EMAIL"].precision, rows["EMAIL"].f1) == (2, 1.0, 1.0)
    assert (rows["PHONE"].fn, rows["PHONE"].recall) == (1, 0.0) and (rows["DIN"].fp, rows["DIN"].precision) == (1, None)
    total = measure.overall_scores(counts).first()
    assert (total.tp, total.fp, total.fn) == (2, 1, 1) and total.precision == pytest.approx(2 / 3)
    assert measure.false_positives(outcomes).first().predicted_text == "12345678" and measure.false_negatives(outcomes).count() == 2
    exact = measure.overall_scores(measure.category_counts(measure.evaluated(pipeline.analyse(tables.ground_truth(spark, str(tmp_path / "gold.json"))), "exact"))).first()
    assert exact.tp == 1
    assert cli.main(["--evaluate", str(tmp_path / "gold.json"), "--report", str(tmp_path / "out")]) == 0
    nothing = measure.overall_scores(measure.category_counts(outcomes.limit(0))).first()
    assert (nothing.precision, nothing.recall, nothing.f1) == (0.0, 0.0, 0.0)
