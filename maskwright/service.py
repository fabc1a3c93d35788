"""Whole-document redaction: a function for bytes, for files, and a small HTTP endpoint over it."""

from __future__ import annotations

import email.parser
import email.policy
import json
import os
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from maskwright.operators import measure
from maskwright.plans import pipeline
from maskwright.sources import docx

MEDIA_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def redact_bytes(spark: SparkSession, content: bytes, config: pipeline.Config = pipeline.Config()) -> tuple[bytes, dict[str, Any]]:
    """The redacted document, and its report: stats, and replacements by type."""
    files = spark.createDataFrame([("document.docx", bytearray(content))], "path string, content binary")
    done = pipeline.redact(docx.paragraphs(files), config).select("doc_id", "seq", "text", "loc", "candidates", "resolved", "redacted_runs").persist()
    try:
        stats = measure.stats(done).drop("doc_id").first()
        by_type = measure.counts_by_type(pipeline.entities(done)).collect()
        out = docx.rewritten(files, done.where(F.size("resolved") > 0)).first()
    finally:
        done.unpersist()
    empty = dict.fromkeys(("processed_paragraphs", "total_candidates", "rejected_by_resolver", "entities_replaced", "replacements_in_tables", "replacements_in_headers_footers", "low_confidence_entities"), 0)
    return bytes(out["content"]), {"stats": stats.asDict() if stats else empty, "entity_counts_by_type": {r["entity_type"]: r["n"] for r in by_type}, "integrity_violations_found": 0}


def report_path(output: str) -> str:
    """Beside an output that lies in a folder named evaluation, else in the working directory's folder of that name, if there is one."""
    beside = os.path.dirname(output)
    shared = os.path.isdir("evaluation") and os.path.basename(beside) != "evaluation"
    return os.path.join("evaluation" if shared else beside, "redaction_integrity_report.json")


def redact_file(spark: SparkSession, source: str, output: str, config: pipeline.Config = pipeline.Config()) -> dict[str, Any]:
    """Redacts one local document and writes its report; many documents go through docx.read, pipeline.redact and docx.rewritten."""
    with open(source, "rb") as f:
        content, report = redact_bytes(spark, f.read(), config)
    with open(output, "wb") as f:
        f.write(content)
    with open(report_path(output), "w", encoding="utf-8") as f:
        json.dump(report, f, indent=4)
    return report


def uploaded(content_type: str, body: bytes) -> tuple[str, bytes] | None:
    """(file name, bytes) of the form field "file"."""
    head = f"Content-Type: {content_type}\r\n\r\n".encode()
    form = email.parser.BytesParser(policy=email.policy.HTTP).parsebytes(head + body)
    for part in form.iter_parts() if form.is_multipart() else ():
        if part.get_param("name", header="content-disposition") == "file":
            return part.get_filename() or "", part.get_payload(decode=True) or b""
    return None


def answer(spark: SparkSession, method: str, path: str, content_type: str = "", body: bytes = b"") -> tuple[int, str, bytes]:
    """(status, media type, body) of a request."""
    said = lambda code, **x: (code, "application/json", json.dumps(x).encode())
    if method == "GET" and path in ("/", "/health"):
        return said(200, status="ok") if path == "/health" else said(200, message="POST a .docx document to /redact")
    if (method, path) != ("POST", "/redact"):
        return said(404, detail="not found")
    form = uploaded(content_type, body)
    if form is None:
        return said(422, detail="the form has no field named file")
    if not form[0].lower().endswith(".docx"):
        return said(415, detail="only .docx documents are accepted")
    if not form[1]:
        return said(400, detail="the document is empty")
    try:
        return 200, MEDIA_TYPE, redact_bytes(spark, form[1])[0]
    except Exception:
        return said(500, detail="the document could not be redacted")


def serve(spark: SparkSession, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server; call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def _reply(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, kind, out = answer(spark, self.command, self.path, self.headers.get("Content-Type", ""), body)
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Access-Control-Allow-Origin", "*")
            if kind == MEDIA_TYPE:
                self.send_header("Content-Disposition", 'attachment; filename="redacted.docx"')
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        def do_OPTIONS(self) -> None:
            self.send_response(204)
            for name, value in (("Origin", "*"), ("Methods", "GET, POST, OPTIONS"), ("Headers", "*")):
                self.send_header(f"Access-Control-Allow-{name}", value)
            self.end_headers()

        do_GET = do_POST = _reply

    return ThreadingHTTPServer((host, port), Handler)
