"""Document fingerprints by winnowing."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import lean, record_batch, shuffle_width, slices
from maskwright.llm.repeats import LAST_ID, mix

#: Of texts of 128 code points and more any match of GRAM + WINDOW - 1 code points is caught by a common fingerprint.
GRAM, WINDOW = 8, 16
#: Stands before a text, in front of its first code point; no code point itself.
BEFORE = 0x110000
CHUNK = 1 << 20
PLACES = pa.list_(pa.struct([("hash", pa.int64()), ("position", pa.int64())]))


def window_of(n: int, window: int = WINDOW) -> int:
    """Grams in a window for a text of n code points: at most an eighth of them, so that short texts have several fingerprints.

    What a longer window chooses, a shorter one chooses too: texts of different lengths stay comparable.
    """
    return min(window, max(1, n // 8))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-grams, by doubling."""
    h = mix(points.astype(np.uint64), np.zeros(len(points), dtype=np.uint64))
    size = 1
    while size * 2 <= k:
        h = mix(h[: len(h) - size], h[size:])
        size *= 2
    return mix(h[: len(h) - (k - size)], h[k - size :]) if size < k else h


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions in code points) of the least gram hash of every window of grams, the rightmost of equals.

    There is a gram that ends with each code point; the first ones reach back before the text, and their position is 0.
    So texts with a common beginning, however short, have common grams. Neighbouring windows with the same choice count
    once; fewer grams than a window are one window; an empty text has none. Short texts have shorter windows
    (window_of), the grams are the same for all. Long texts go through in pieces that overlap by a window, which choose
    the same.
    """
    points = code_points(text)
    if not len(points):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    window = window_of(len(points), window)
    points = np.concatenate([np.full(gram - 1, BEFORE, dtype=points.dtype), points])
    found, step = [], CHUNK
    for at in range(0, max(1, len(points) - gram - window + 2), step):
        h = gram_hashes(points[at : at + step + gram + window - 2], gram)
        n = min(window, len(h))
        # the hash's upper half decides; below it the position, so that of equals the rightmost is least
        v = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
        size = 1
        while size * 2 <= n:
            v = np.minimum(v[: len(v) - size], v[size:])
            size *= 2
        if size < n:
            v = np.minimum(v[: len(v) - (n - size)], v[n - size :])
        place = (np.uint64(0xFFFFFFFF) - (v & np.uint64(0xFFFFFFFF))).astype(np.int64)
        place = place[np.r_[True, place[1:] != place[:-1]]]
        found.append((h[place], place + at))
    hashes, places = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.r_[True, places[1:] != places[:-1]]
    return hashes[new], np.maximum(places[new] - (gram - 1), 0)


def fingerprint_of(hashes: np.ndarray) -> np.ndarray:
    """The different hashes, in 32 bits, ascending."""
    return np.unique((hashes >> np.uint64(32)).astype(">u4"))


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard index of two fingerprints; two empty ones are alike."""
    if not len(x) and not len(y):
        return 1.0
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) of the code points replaced by the first as many, or all, of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hashes, positions) per row; null and empty texts have empty arrays."""
    schema = pa.schema([("doc_id", pa.int64()), ("hashes", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64()))])

    def run(batches):
        for batch in slices(batches, CHUNK):
            got = [winnow(t or "", gram, window) for t in batch.column("text").to_pylist()]
            yield record_batch(schema, batch.column("doc_id"), [h.view(np.int64) for h, _ in got], [p for _, p in got])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, hashes array<long>, positions array<long>")


def edit_report(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, positions.

    The following document is that of the next id, after the last the first; rows that share an id follow each other in
    their texts' order, a null id counts as the largest. Fingerprints are 8 hex digits for each 32-bit hash, ascending;
    likeness is the Jaccard index of fingerprints; positions are where in the text its chosen grams begin, with their
    hashes, in the order of the text, for those who look for the matches that common fingerprints stand for. Null and empty texts have an empty fingerprint; a single document
    follows itself; an empty table gives an empty one; other columns are ignored.

    The rows are dealt to ranges of ids, whose first rows also go to the range before, so that every range knows what
    follows its last row: one shuffle of the texts, and a task holds two documents at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = 4 * shuffle_width(spark)
    least, cuts = rows.agg(F.min("doc"), F.percentile_approx("doc", [i / parts for i in range(1, parts)], 100 * parts)).first()
    cuts = sorted({c for c in cuts or [] if c > least})
    last = len(cuts)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("positions", PLACES)])

    def place(batches):
        """Adds the range, twice for a row with the first id of one."""
        ends = np.array(cuts, dtype=np.int64)
        for batch in batches:
            doc = batch.column("doc").to_numpy()
            part = np.searchsorted(ends, doc, "right").astype(np.int32)
            first = np.isin(doc, ends) | (doc == least)
            before = np.where(part[first] == 0, last, part[first] - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part), pa.array(np.zeros(len(part), dtype=np.int32))], names=[*batch.schema.names, "part", "beyond"])
            if first.any():
                more = batch.filter(pa.array(first))
                yield pa.RecordBatch.from_arrays([*more.columns, pa.array(before), pa.array(np.ones(len(before), dtype=np.int32))], names=[*batch.schema.names, "part", "beyond"])

    def report(batches):
        held, part_of = None, None

        def line(now, then):
            changed = edited(now[1], then[1])
            own, other = now[2], fingerprint_of(winnow(changed, gram, window)[0])
            hashes, places = now[3]
            chosen = pa.array((hashes >> np.uint64(32)).astype(np.int64)), pa.array(places)
            return now[0], len(now[1]), hashlib.sha256(changed.encode()).hexdigest(), own.tobytes().hex(), other.tobytes().hex(), likeness(own, other), likeness(own, then[2]), chosen

        for whole in batches:
            for batch in slices([whole], CHUNK):
                out = []
                for doc_id, text, part, beyond in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part", "beyond")), strict=True):
                    if part != part_of:
                        held, part_of = None, part
                    if beyond and held is None:
                        continue
                    chosen = winnow(text, gram, window)
                    this = doc_id, text, fingerprint_of(chosen[0]), chosen
                    if held is not None:
                        out.append(line(held, this))
                    held = None if beyond else this
                if out:
                    *columns, chosen = zip(*out, strict=True)
                    offsets = pa.array(np.cumsum([0, *(len(c[0]) for c in chosen)]).astype(np.int32))
                    structs = pa.StructArray.from_arrays([pa.concat_arrays([c[k] for c in chosen]) for k in (0, 1)], fields=list(PLACES.value_type))
                    yield record_batch(schema, *columns, pa.ListArray.from_arrays(offsets, structs, type=PLACES))

    placed = rows.mapInArrow(lean(place), "doc long, doc_id long, text string, part int, beyond int")
    dealt = placed.repartition(shuffle_width(spark), "part").sortWithinPartitions("part", "beyond", "doc", "text")
    names = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<struct<hash:long,position:long>>"
    return dealt.mapInArrow(lean(report), names)
