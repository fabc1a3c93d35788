"""Packaged word-processor documents (.docx): paragraphs out, rewritten paragraphs in."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.sources.tables import LOCATION

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
MAIN = "word/document.xml"
_NOT_XML = re.compile(r"[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
RUNS = "array<struct<run_index:int,text:string>>"
PARAGRAPHS = f"doc_id string, seq int, text string, header_text string, loc {LOCATION}, runs {RUNS}"


def _parsed(xml: bytes) -> ET.Element:
    """The tree of a part; the prefixes of its namespaces stay when it is written."""
    events = ET.iterparse(io.BytesIO(xml), events=["start-ns"])
    for _, (prefix, uri) in events:
        if prefix and not prefix.startswith("ns"):
            ET.register_namespace(prefix, uri)
    return events.root


def run_text(run: ET.Element) -> str:
    if len(run) == 1 and run[0].tag == f"{_W}t":  # as nearly all are
        return run[0].text or ""
    out = []
    for x in run:
        if x.tag == f"{_W}t":
            out.append(x.text or "")
        elif x.tag == f"{_W}tab":
            out.append("\t")
        elif x.tag in (f"{_W}br", f"{_W}cr"):
            out.append("\n")
    return "".join(out)


def set_run_text(run: ET.Element, text: str) -> None:
    """Puts text in the place of all the run's text, its properties stay."""
    for x in [x for x in run if x.tag in {f"{_W}{n}" for n in ("t", "tab", "br", "cr")}]:
        run.remove(x)
    t = ET.SubElement(run, f"{_W}t", {_SPACE: "preserve"})
    t.text = text


@dataclass
class Paragraph:
    """A paragraph as it was when it was met; its text is that of the runs, so that its offsets are theirs."""

    element: ET.Element
    location: dict
    header_text: str | None = None

    def __post_init__(self):
        self.runs = self.element.findall(f"{_W}r")
        self.run_texts = [run_text(r) for r in self.runs]
        self.text = "".join(self.run_texts)


class Package:
    """A document's parts, and its paragraphs in the order in which they count.

    First the body's paragraphs, then its tables row by row, then each section's header and footer, each with its tables;
    a cell's nested tables follow its paragraphs. Paragraphs without text don't count. A cell that spans columns or rows,
    and a header that sections share, is met once.
    """

    def __init__(self, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            self.infos = z.infolist()
            self.files = {i.filename: z.read(i) for i in self.infos}
        self.trees: dict[str, ET.Element] = {}

    def tree(self, name: str) -> ET.Element:
        if name not in self.trees:
            self.trees[name] = _parsed(self.files[name])
        return self.trees[name]

    def _related(self) -> dict[str, str]:
        name = "word/_rels/document.xml.rels"
        if name not in self.files:
            return {}
        return {x.get("Id"): posixpath.normpath(posixpath.join("word", x.get("Target", "").lstrip("/"))) for x in ET.fromstring(self.files[name])}

    def paragraphs(self) -> Iterator[Paragraph]:
        body = self.tree(MAIN).find(f"{_W}body")
        yield from self._block(body, {})
        related, seen = self._related(), set()
        for section in self.tree(MAIN).iter(f"{_W}sectPr"):
            for tag, flag in ((f"{_W}headerReference", "is_header"), (f"{_W}footerReference", "is_footer")):
                for ref in section.findall(tag):
                    part = related.get(ref.get(f"{_R}id"))
                    if ref.get(f"{_W}type", "default") == "default" and part in self.files and part not in seen:
                        seen.add(part)
                        yield from self._block(self.tree(part), {flag: True})

    def _block(self, parent: ET.Element, location: dict) -> Iterator[Paragraph]:
        for i, p in enumerate(parent.findall(f"{_W}p")):
            found = Paragraph(p, {**location, "paragraph_index": i})
            if found.text.strip():
                yield found
        yield from self._tables(parent, location)

    def _cells(self, row: ET.Element) -> Iterator[tuple[int, ET.Element, bool]]:
        """(column, cell, whether it only continues the cell above)."""
        at = 0
        for cell in row.findall(f"{_W}tc"):
            props = cell.find(f"{_W}tcPr")
            span = props.find(f"{_W}gridSpan") if props is not None else None
            merge = props.find(f"{_W}vMerge") if props is not None else None
            yield at, cell, merge is not None and merge.get(f"{_W}val", "continue") == "continue"
            at += int(span.get(f"{_W}val", "1")) if span is not None else 1

    def _tables(self, parent: ET.Element, location: dict) -> Iterator[Paragraph]:
        for t, table in enumerate(parent.findall(f"{_W}tbl")):
            rows = table.findall(f"{_W}tr")
            headers: dict[int, str] = {}
            for column, cell, _ in self._cells(rows[0]) if rows else ():
                headers[column] = "\n".join("".join(map(run_text, p.findall(f"{_W}r"))) for p in cell.findall(f"{_W}p")).strip()
            for r, row in enumerate(rows):
                for column, cell, continued in self._cells(row):
                    if continued:
                        continue
                    for i, p in enumerate(cell.findall(f"{_W}p")):
                        found = Paragraph(p, {**location, "table_index": t, "row_index": r, "cell_index": column, "paragraph_index": i, "is_header": r == 0}, headers.get(column, ""))
                        if found.text.strip():
                            yield found
                    yield from self._tables(cell, location)

    def save(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for info in self.infos:
                data = ET.tostring(self.trees[info.filename], encoding="UTF-8", xml_declaration=True) if info.filename in self.trees else self.files[info.filename]
                z.writestr(info, data)
        return out.getvalue()


_PLACES, _FLAGS = ("paragraph_index", "table_index", "row_index", "cell_index"), ("is_header", "is_footer")
_BATCH = 10_000


def _batch(name: str, first: int, some: list[Paragraph]) -> pa.RecordBatch:
    texts = [t for p in some for t in p.run_texts]
    ends = np.cumsum([0, *[len(p.run_texts) for p in some]])
    places = np.arange(len(texts)) - np.repeat(ends[:-1], np.diff(ends))
    runs = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(texts, pa.string())], ["run_index", "text"])
    loc = [pa.array([p.location.get(f) for p in some], pa.int32()) for f in _PLACES] + [pa.array([p.location.get(f, False) for p in some], pa.bool_()) for f in _FLAGS]
    columns = {
        "doc_id": pa.array([name] * len(some), pa.string()),
        "seq": pa.array(range(first, first + len(some)), pa.int32()),
        "text": pa.array([p.text for p in some], pa.string()),
        "header_text": pa.array([p.header_text for p in some], pa.string()),
        "loc": pa.StructArray.from_arrays(loc, [*_PLACES, *_FLAGS]),
        "runs": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs),
    }
    return pa.RecordBatch.from_pydict(columns)


def batches_of(name: str, content: bytes) -> list[pa.RecordBatch]:
    """A document's paragraphs as PARAGRAPHS."""
    found = list(Package(content).paragraphs())
    return [_batch(name, at, found[at : at + _BATCH]) for at in range(0, len(found), _BATCH)]


def plain_package(paragraphs: Iterable[Iterable[str]]) -> bytes:
    """A document of paragraphs, each given by the texts of its runs; characters that XML can't hold become U+FFFD."""
    run = "<w:r><w:t xml:space=\"preserve\">{}</w:t></w:r>".format
    body = "".join(f"<w:p>{''.join(run(escape(t)) for t in texts)}</w:p>" for texts in paragraphs)
    document = f'<?xml version="1.0" encoding="UTF-8"?>\n<w:document xmlns:w="{_W[1:-1]}"><w:body>{_NOT_XML.sub("\ufffd", body)}</w:body></w:document>'
    kinds = "application/vnd.openxmlformats-"
    files = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="{kinds}package.relationships+xml"/><Override PartName="/{MAIN}" ContentType="{kinds}officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_R[1:-1]}/officeDocument" Target="{MAIN}"/></Relationships>',
        MAIN: document.encode(),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def packed(paragraphs: DataFrame) -> DataFrame:
    """Files (path, content), one for each path, of paragraphs (path, seq, texts: the runs' texts) in order of seq; a document is held whole."""
    paragraphs = paragraphs.repartition(int(paragraphs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")  # few bytes, much work: not to be put together
    texts = paragraphs.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("seq", "texts"))).alias("p")).select("path", F.transform("p", lambda p: p["texts"]).alias("texts"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"].to_numpy(), "content": [plain_package(texts) for texts in frame["texts"]]})

    return texts.mapInPandas(run, "path string, content binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files; a document is a row, read whole."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")


def paragraphs(files: DataFrame) -> DataFrame:
    """Paragraphs (doc_id: the path, seq, text, header_text, loc, runs) of files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield from batches_of(path, content.as_py())

    return files.mapInArrow(run, PARAGRAPHS)


def rewritten(files: DataFrame, redacted: DataFrame) -> DataFrame:
    """files (path, content) with the runs of redacted (doc_id, seq, redacted_runs) put in; all else of the package stays."""
    edits = redacted.groupBy(F.col("doc_id").alias("path")).agg(F.collect_list(F.struct("seq", "redacted_runs")).alias("edits"))

    def changed(content: bytes, edits: pa.StructArray) -> bytes:
        package, runs = Package(content), edits.field("redacted_runs")
        ends, flat = runs.offsets.to_numpy(), runs.values
        places, texts = flat.field("run_index").to_numpy(zero_copy_only=False), flat.field("text")
        wanted = {seq: (ends[i], ends[i + 1]) for i, seq in enumerate(edits.field("seq").to_pylist())}
        for seq, p in enumerate(package.paragraphs()):
            a, b = wanted.get(seq, (0, 0))
            for at, text in zip(places[a:b].tolist(), texts[a:b].to_pylist(), strict=True):
                if p.run_texts[at] != text:
                    set_run_text(p.runs[at], text)
        return package.save()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = (c.as_py() for c in batch.column("content"))
            out = [changed(c, e.values) if e.is_valid and len(e.values) else c for c, e in zip(contents, batch.column("edits"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.binary())], ["path", "content"])

    return files.join(edits, "path", "left").mapInArrow(run, "path string, content binary")
