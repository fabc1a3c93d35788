"""Command line: python -m maskwright.cli -i in.docx -o out.docx."""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import SparkSession

from maskwright import service
from maskwright.operators import audit, measure
from maskwright.operators.names import ListProvider, ModelProvider
from maskwright.plans import pipeline
from maskwright.sources import docx, tables


def session() -> SparkSession:
    return SparkSession.builder.appName("maskwright").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _config(args: argparse.Namespace) -> pipeline.Config:
    provider = None
    if args.no_ner:
        return pipeline.Config()
    if args.names:
        with open(args.names, encoding="utf-8") as f:
            provider = ListProvider(**json.load(f))
    elif ModelProvider.installed():
        provider = ModelProvider(args.model)
    return pipeline.Config(name_provider=provider)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Finds and replaces sensitive spans in .docx documents.")
    parser.add_argument("--input", "-i", help="document to redact")
    parser.add_argument("--output", "-o", help="where the redacted document goes")
    parser.add_argument("--debug", action="store_true")
    parser.add_argument("--no-ner", action="store_true", help="look for no names, whatever is installed or given by --names")
    parser.add_argument("--names", help="JSON file with lists people, organisations, places")
    parser.add_argument("--model", default="en_core_web_sm", help="spaCy model that finds names, if spaCy is installed")
    parser.add_argument("--evaluate", metavar="JSON", help="score the detectors against expected findings")
    parser.add_argument("--audit", metavar="REDACTED", help="compare a redacted document with --input")
    parser.add_argument("--report", default="evaluation", help="folder for the reports of --evaluate and --audit")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.debug else logging.INFO, format="%(levelname).1s %(asctime)s %(name)s: %(message)s")
    if args.evaluate:
        config = pipeline.Config(name_provider=_config(args).name_provider, use_memo=False)
        outcomes = measure.evaluated(pipeline.analyse(tables.ground_truth(session(), args.evaluate), config)).persist()
        counts = measure.category_counts(outcomes)
        measure.overall_scores(counts).show(truncate=False)
        measure.category_scores(counts).orderBy("category").show(50, truncate=False)
        measure.write_failures(outcomes, args.report)
        return 0
    if not args.input or not os.path.exists(args.input):
        logging.error("there is no document at %s", args.input)
        return 0
    if args.audit:
        spark = session()
        read = lambda path: docx.paragraphs(spark.read.format("binaryFile").load(path).select("path", "content"))
        expected = pipeline.redact(read(args.input), _config(args)).drop("doc_id").selectExpr("'document' doc_id", "*")
        actual = read(args.audit).selectExpr("'document' doc_id", "seq", "text actual_text")
        found = audit.audit(expected, actual)
        found.totals.show()
        os.makedirs(args.report, exist_ok=True)
        with open(os.path.join(args.report, "redaction_audit.json"), "w", encoding="utf-8") as f:
            json.dump(found.document(), f, indent=4)
        return 0
    if not args.output:
        parser.error("--output is needed")
    report = service.redact_file(session(), args.input, args.output, _config(args))
    logging.info("redacted %s: %s", args.input, report["stats"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
