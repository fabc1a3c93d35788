"""Suffix-array deduplication of bytes: repeats of at least a threshold, by a depth-limited radix sort.

A suffix array of the corpus would order every suffix. Here suffixes are ordered only through threshold bytes, most
significant digit first: the first digit is the hash of the gram that anchors the suffix's beginning, which deals
suffixes to tasks (see `repeats`); every further digit is five literal bytes, and a suffix that is alone under a digit
is done. Groups that reach the threshold together are exactly the repeated windows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame

from maskwright.llm import repeats
from maskwright.llm.common import Written, lean, record_batch, slices

#: The first digit's values are taken in so many parts, so that less lies on disk at a time.
PASSES = 3


def byte_windows(threshold: int = 100) -> repeats.Kind:
    return repeats.Kind(words=False, window=threshold, gram=min(threshold, max(1, threshold // 4)))


def removed(docs: DataFrame, threshold: int = 100, passes: int = PASSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, kept (the bytes left), n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of threshold bytes covers it that also starts earlier (smaller id, or the same document
    further ahead); overlapping ones count, matches stay inside documents and strings are judged on the input. Null and
    empty texts have no bytes; texts shorter than the threshold keep all; a null id counts as the largest; rows that
    repeat id and text get the same result; an empty table gives an empty one; other columns are ignored.
    """
    kind = byte_windows(threshold)
    rows, texts = repeats.keyed(docs, id_col, text_col)
    written = Written(docs.sparkSession)
    spans = repeats.repeated_spans(texts, kind, written, passes)
    out = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in slices(batches, kind.chunk):
            got = []
            for text, found in zip(batch.column("text"), batch.column("spans"), strict=True):
                text = text.as_buffer().to_pybytes()
                starts, stops = repeats.covered(len(text), found)
                kept = b"".join(text[a:b] for a, b in zip([0, *stops.tolist()], [*starts.tolist(), len(text)], strict=True))
                got.append((kept, len(text), int((stops - starts).sum()), len(starts), hashlib.sha256(kept).hexdigest()))
            yield record_batch(out, batch.column("id"), *zip(*got, strict=True))

    return repeats.with_spans(rows.drop("rest"), spans).mapInArrow(lean(run), "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
