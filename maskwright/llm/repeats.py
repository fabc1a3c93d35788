"""Exact repeats of fixed windows over a whole corpus, compared symbol by symbol in depth-limited radix passes.

A window is so many consecutive symbols (bytes or words) of one text. What is sought are the windows that also start
earlier in the corpus.

1. *First digit.* Of the grams inside a window the one with the least hash (rightmost of equals) is its anchor. Equal
   windows have equal anchors at equal places, so the anchor's hash deals them to the same task. The consecutive windows
   with one anchor are a block, which travels as one row with the symbols that its windows cover.
2. *Further digits.* Rows that share the first digit are compared on their literal bytes, five at a time, most significant
   first; what is alone under a digit leaves, and nothing is looked at beyond a window's end (`equal_classes`). Blocks come
   first: of equal ones all but the earliest are repeats as a whole. Then the windows of those that are left.

Equal means equal bytes: hashes only decide where rows meet. A chunk of text compares its own blocks first, so that it
sends each content once; an anchor with more rows than a task should hold sends its windows on, each dealt by its own
hash, so that no group is ever held whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import Written, lean, record_batch, shuffle_width, slices

#: n: windows of a block; 0 marks a span of repeated symbols (lo to at, ends included), below 0 it is a block of an index's run. at: the anchor's place in the block.
ROWS = "g long, gen int, doc long, copy long, lo int, n int, at int, text binary"
SCHEMA = pa.schema([("g", pa.int64()), ("gen", pa.int32()), ("doc", pa.int64()), ("copy", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("at", pa.int32()), ("text", pa.binary())])
#: Bytes of rows that are settled together, and beyond which the rows of one anchor are thinned out.
HELD = 5 << 20
_ROW = 64  # bytes of a row besides its text
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_S29, _S32 = np.uint64(29), np.uint64(32)
_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
LAST_ID = (1 << 63) - 1
#: Bytes whose hashes are summed up at once.
PART = 1 << 18


@dataclass(frozen=True)
class Kind:
    """words: symbols are words, else bytes. window, gram, piece (what is cut from a long text at once): in symbols; chunk: bytes of text."""

    words: bool
    window: int
    gram: int
    piece: int = 1 << 17
    chunk: int = 3 << 20
    held: int = field(default=HELD)


def mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A hash of the pair, in order."""
    z = x * _A
    z += y
    z ^= z >> _S29
    z *= _B
    z ^= z >> _S32
    return z


#: A fixed pseudo-random odd value for each byte.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407), np.arange(256, dtype=np.uint64)) | np.uint64(1)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse, modulo 2**64."""
    out = []
    for base in (int(_A), pow(int(_A), -1, 1 << 64)):
        p = np.full(PART + 1, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte value times power, of each beginning of data (at most PART bytes)."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * _powers()[0][: len(data)], out=out[1:])
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes: sum of byte value times power of the place in the word."""
    power, inverse = _powers()
    out, i = np.empty(len(starts), dtype=np.uint64), 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + PART, "right")))
        if ends[j - 1] - base <= PART:
            s, e = starts[i:j] - base, ends[i:j] - base
            sums = _sums(data[base : base + int(e[-1])])
            out[i:j] = (sums[e] - sums[s]) * inverse[s]
        else:  # one very long word, part by part
            total, shift = 0, 1
            for at in range(base, int(ends[i]), PART):
                part = data[at : min(at + PART, int(ends[i]))]
                total += int(_sums(part)[-1]) * shift
                shift = shift * int(power[PART]) % (1 << 64)
            out[i] = total % (1 << 64)
        i = j
    return mix(out, out)


def _doubled(v: np.ndarray, n: int, join) -> np.ndarray:
    """join over all runs of n."""
    size = 1
    while size * 2 <= n:
        v = join(v[: len(v) - size], v[size:])
        size *= 2
    return join(v[: len(v) - (n - size)], v[n - size :]) if size < n else v


def _grams(kind: Kind, data: np.ndarray, starts: np.ndarray | None, ends: np.ndarray | None) -> np.ndarray:
    if kind.words:
        return _doubled(word_hashes(data, starts, ends), kind.gram, mix)
    out = np.empty(len(data) - kind.gram + 1, dtype=np.uint64)
    step = PART - kind.gram + 1
    for at in range(0, len(out), step):
        sums = _sums(data[at : at + step + kind.gram - 1])
        h = sums[kind.gram :] - sums[: -kind.gram]
        h *= _powers()[1][: len(h)]
        out[at : at + step] = h
    out ^= out >> _S32
    out *= _B
    return out


def blocks(kind: Kind, data: np.ndarray, starts: np.ndarray | None, ends: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor, the anchor's hash) of each block of a text of at least one window."""
    h = _grams(kind, data, starts, ends)
    order = h & _HIGH
    order |= _LOW - np.arange(len(h), dtype=np.uint64)
    anchor = (_LOW - (_doubled(order, kind.window - kind.gram + 1, np.minimum) & _LOW)).astype(np.int64)
    new = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    lo = np.r_[0, new]
    anchor = anchor[lo]
    return lo, np.r_[new - 1, len(data if starts is None else starts) - kind.window], anchor, h[anchor]


def symbols(kind: Kind, text: bytes) -> tuple[bytes, np.ndarray | None, np.ndarray | None, int]:
    """(bytes, starts, ends, count) of a text's symbols; words are joined by one space."""
    if not kind.words:
        return text, None, None, len(text)
    words = text.split()
    data = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32)
    return data, np.r_[0, gaps + 1], np.r_[gaps, len(data)], len(words)


# ---- rows side by side ------------------------------------------------------------------------------------------------


@dataclass
class Rows:
    """Blocks whose anchors' hashes ascend, in document order under each; text: where each one's bytes lie in data."""

    g: np.ndarray
    gen: np.ndarray
    doc: np.ndarray
    copy: np.ndarray
    lo: np.ndarray
    n: np.ndarray
    at: np.ndarray
    start: np.ndarray
    length: np.ndarray
    data: np.ndarray

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch) -> Rows:
        values = [table.column(c).to_numpy() for c in ("g", "gen", "doc", "copy", "lo", "n", "at")]
        text = table.column("text")
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        g, gen, doc, copy, lo = values[:5]
        order = np.lexsort((lo, copy, doc, gen, g))
        return cls(*(v[order] for v in values), (offsets[:-1] - offsets[0])[order], np.diff(offsets)[order], data)

    def take(self, rows: np.ndarray) -> Rows:
        return Rows(*(getattr(self, c)[rows] for c in ("g", "gen", "doc", "copy", "lo", "n", "at", "start", "length")), self.data)

    def batch(self) -> pa.RecordBatch:
        raw = self.data.tobytes()
        text = [raw[a:b] for a, b in zip(self.start.tolist(), (self.start + self.length).tolist(), strict=True)]
        return record_batch(SCHEMA, self.g, self.gen, self.doc, self.copy, self.lo, self.n, self.at, text)


def equal_classes(group: np.ndarray, start: np.ndarray, length: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A number for each element, the same for those of one group with the same bytes; -1 for an element that is alone.

    Depth-limited radix passes: in each the elements are ordered by five more bytes, and those that are alone leave. All
    elements of a group have the same length.
    """
    out, made, depth = np.full(len(group), -1, dtype=np.int64), 0, 0
    padded = np.r_[data, np.zeros(5, dtype=np.uint8)].astype(np.uint64)
    digits = np.zeros(len(data) + 1, dtype=np.uint64)
    for k in range(5):
        digits <<= np.uint64(8)
        digits |= padded[k : k + len(digits)]
    alive, key = np.arange(len(group)), group.astype(np.uint64)
    while True:
        order = np.argsort(key)
        key = key[order]
        new = np.r_[True, key[1:] != key[:-1]][: len(key)]
        ids = np.cumsum(new) - 1
        more = (np.bincount(ids) > 1)[ids] if len(ids) else new
        alive, ids = alive[order[more]], (np.cumsum(new & more) - 1)[more]
        left = length[alive] - depth
        over = left <= 0
        if over.any():
            out[alive[over]] = made + ids[over]
            made += int(ids[-1]) + 1
            alive, ids, left = alive[~over], ids[~over], left[~over]
        if not len(alive):
            return out
        digit = digits[start[alive] + depth] >> (8 * np.maximum(0, 5 - left)).astype(np.uint64)
        key = (ids.astype(np.uint64) << np.uint64(40)) | digit
        depth += 5


def later_ones(classes: np.ndarray) -> np.ndarray:
    """Marks all but the first element of each class."""
    some = np.flatnonzero(classes >= 0)
    out = np.zeros(len(classes), dtype=bool)
    out[some] = True
    out[some[np.unique(classes[some], return_index=True)[1]]] = False
    return out


def _dense(*keys: np.ndarray) -> np.ndarray:
    """Numbers from 0 for pairs of numbers below 2**32."""
    key = keys[0].astype(np.uint64) << _S32 | keys[1].astype(np.uint64)
    return np.unique(key, return_inverse=True)[1]


def _runs(g: np.ndarray) -> np.ndarray:
    return np.cumsum(np.r_[False, g[1:] != g[:-1]]) if len(g) else np.zeros(0, dtype=np.int64)


def span_rows(gen, doc, copy, lo, hi) -> pa.RecordBatch:
    spread = mix(doc.astype(np.int64).view(np.uint64), lo.astype(np.uint64)).view(np.int64)
    return record_batch(SCHEMA, spread, gen, doc, copy, lo, np.zeros(len(lo), dtype=np.int32), hi, pa.nulls(len(lo), pa.binary()))


def repeated_blocks(rows: Rows) -> np.ndarray:
    """Marks blocks that equal an earlier one."""
    return later_ones(equal_classes(_dense(_runs(rows.g), rows.length), rows.start, rows.length, rows.data))


def windows_of(rows: Rows, kind: Kind) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the block, start of bytes, their number) of all windows."""
    n = rows.n.astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    if not kind.words:
        return row, place, rows.start[row] + place, np.full(len(row), kind.window, dtype=np.int64)
    gaps = np.flatnonzero(rows.data == 32)
    starts = np.sort(np.r_[np.unique(rows.start), gaps + 1])
    ends = np.sort(np.r_[np.unique(rows.start + rows.length), gaps])
    # bytes of rows that have been left out lie between: their ends and starts are looked up, not counted
    first = np.searchsorted(starts, rows.start)[row] + place
    start = starts[first]
    last = np.searchsorted(ends, rows.start, "right")[row] + place + kind.window - 1
    return row, place, start, ends[last] - start


def repeated_windows(rows: Rows, kind: Kind) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """The windows of rows, and which of them equal an earlier one."""
    found = row, place, start, length = windows_of(rows, kind)
    second = length if kind.words else rows.at[row] - place
    classes = equal_classes(_dense(_runs(rows.g)[row], second), start, length, rows.data)
    return found, later_ones(classes)


def _joined(row: np.ndarray, place: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of marked windows."""
    at = np.flatnonzero(marked)
    new = np.r_[True, (row[at][1:] != row[at][:-1]) | (place[at][1:] != place[at][:-1] + 1)][: len(at)]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1][: int(new.sum())]
    return row[at[new]], place[at[new]], place[at[last]]


def _spans(rows: Rows, which: np.ndarray, first: np.ndarray, last: np.ndarray, kind: Kind, gen: int):
    now = rows.gen[which] == gen
    which, first, last = which[now], first[now], last[now]
    if len(which):
        yield span_rows(rows.gen[which], rows.doc[which], rows.copy[which], rows.lo[which] + first.astype(np.int32), rows.lo[which] + (last + kind.window - 1).astype(np.int32))


def _kept(rows: Rows, which: np.ndarray, gen: int):
    """Those of the blocks that generation gen adds to an index."""
    which = which & (rows.gen == gen)
    if which.any():
        out = rows.take(np.flatnonzero(which))
        out.n = -out.n
        yield out.batch()


def settled(rows: Rows, kind: Kind, gen: int, keep: bool):
    """Spans of generation gen, from all rows of some anchors; with keep also its first blocks."""
    again = repeated_blocks(rows)
    if keep:
        yield from _kept(rows, ~again, gen)
    which = np.flatnonzero(again)
    yield from _spans(rows, which, np.zeros(len(which), dtype=np.int32), rows.n[which] - 1, kind, gen)
    run = _runs(rows.g)
    contested = ~again & (np.bincount(run[~again], minlength=int(run[-1]) + 1) > 1)[run]
    if contested.any():
        rows = rows.take(np.flatnonzero(contested))
        (row, place, _, _), later = repeated_windows(rows, kind)
        yield from _spans(rows, *_joined(row, place, later), kind, gen)


def thinned(rows: Rows, kind: Kind, gen: int) -> tuple[list[pa.RecordBatch], Rows]:
    """Spans of the repeated blocks of one anchor, and the blocks that are left."""
    again = repeated_blocks(rows)
    which = np.flatnonzero(again)
    return list(_spans(rows, which, np.zeros(len(which), dtype=np.int32), rows.n[which] - 1, kind, gen)), rows.take(np.flatnonzero(~again))


def opened(rows: Rows, kind: Kind, gen: int, keep: bool):
    """The windows of some blocks of one anchor as rows of their own, dealt by their own hashes; spans of those that repeat here."""
    if keep:
        yield from _kept(rows, np.ones(len(rows.g), dtype=bool), gen)
    (row, place, start, length), later = repeated_windows(rows, kind)
    yield from _spans(rows, *_joined(row, place, later), kind, gen)
    at = np.flatnonzero(~later)
    raw = rows.data.tobytes()
    text = [raw[a:b] for a, b in zip(start[at].tolist(), (start + length)[at].tolist(), strict=True)]
    g = np.fromiter(map(xxhash.xxh64_intdigest, text), dtype=np.uint64, count=len(text)).view(np.int64)
    row, one = row[at], np.ones(len(at), dtype=np.int32)
    yield record_batch(SCHEMA, g, rows.gen[row], rows.doc[row], rows.copy[row], rows.lo[row] + place[at].astype(np.int32), one, one - 1, text)


def settle(batches, kind: Kind, gen: int, keep: bool = False):
    """Spans, and windows to be dealt once more, from rows whose anchors' hashes ascend; spans among them pass.

    keep: also the blocks that generation gen adds to an index, of equal ones the first.
    """
    held, size, open_g, last = [], 0, None, None

    def done(table):
        nonlocal open_g
        g = table.column("g").to_numpy()
        if open_g is not None:
            cut = int(np.searchsorted(g, open_g, "right"))
            if cut:
                yield from opened(thin(table.slice(0, cut)), kind, gen, keep)
                table, g = table.slice(cut), g[cut:]
            if len(g):
                open_g = None
        run = _runs(g)
        fresh = np.bincount(run, weights=table.column("gen").to_numpy() == gen) > 0 if len(g) else run
        shared = ((np.bincount(run) > 1) & fresh)[run] if len(g) else run.astype(bool)
        if shared.any():
            yield from settled(Rows.of(table.filter(pa.array(shared))), kind, gen, keep)
        if keep and len(g):
            alone = ~shared & (table.column("gen").to_numpy() == gen)
            for batch in table.filter(pa.array(alone)).to_batches():
                yield batch.set_column(SCHEMA.get_field_index("n"), SCHEMA.field("n"), pc.negate(batch.column("n")))

    spare: list[pa.RecordBatch] = []

    def thin(table):
        spans, rows = thinned(Rows.of(table), kind, gen)
        spare.extend(spans)
        return rows

    for batch in batches:
        n = batch.column("n").to_numpy()
        if (n == 0).any():
            yield batch.filter(pa.array(n == 0))
            batch = batch.filter(pa.array(n > 0))
        if not batch.num_rows:
            continue
        g = batch.column("g").to_numpy()
        if (last is not None and g[0] < last) or (g[1:] < g[:-1]).any():
            raise ValueError("rows are not in the order of their anchors")
        last = g[-1]
        held.append(batch)
        size += batch.nbytes + _ROW * batch.num_rows
        if size < kind.held:
            continue
        table = pa.Table.from_batches(held)
        cut = int(np.searchsorted(table.column("g").to_numpy(), last, "left"))
        if cut:
            yield from done(table.slice(0, cut))
            table = table.slice(cut)
        if table.nbytes + _ROW * len(table) >= kind.held:  # a single anchor's
            rows = thin(table)
            if (rows.n > 1).any() and (open_g is not None or 2 * (int(rows.length.sum()) + _ROW * len(rows.g)) > kind.held):
                open_g = last
                yield from opened(rows, kind, gen, keep)
                table = table.slice(0, 0)
            else:
                table = pa.Table.from_batches([rows.batch()])
        held = table.to_batches()
        size = sum(b.nbytes + _ROW * b.num_rows for b in held)
        yield from spare
        spare.clear()
    if held:
        yield from done(pa.Table.from_batches(held))
    yield from spare


def distinct_blocks(batches, held_bytes: int = HELD):
    """The earliest of equal blocks, from a run's rows, whose anchors' hashes ascend, in that order."""
    held, size = [], 0

    def kept(table):
        g = table.column("g").to_numpy()
        run = _runs(g)
        shared = (np.bincount(run) > 1)[run]
        if not shared.any():
            return table.to_batches()
        rows = Rows.of(table)
        return [rows.take(np.flatnonzero(~repeated_blocks(rows))).batch()]

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= held_bytes:
            table = pa.Table.from_batches(held)
            g = table.column("g").to_numpy()
            # a single anchor's blocks go out in parts: equal ones in different parts both stay, which costs room only
            cut = int(np.searchsorted(g, g[-1], "left")) or len(g)
            yield from kept(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            size = sum(b.nbytes for b in held)
    if held:
        yield from kept(pa.Table.from_batches(held))


# ---- over tables ------------------------------------------------------------------------------------------------------


def scan(docs: DataFrame, kind: Kind, gen: int = 0, part: int = 0, parts: int = 1) -> DataFrame:
    """Blocks of all texts of docs (doc, copy, text) whose anchors' hashes leave the given rest, and spans of blocks that repeat inside a chunk."""

    def sent(chunk: list[tuple]):
        if not chunk:
            return
        g, doc, copy, lo, n, at = (np.concatenate(x) for x in list(zip(*chunk, strict=True))[:6])
        text = [t for x in chunk for t in x[6]]
        batch = record_batch(SCHEMA, g, np.full(len(g), gen, dtype=np.int32), doc, copy, lo.astype(np.int32), n.astype(np.int32), at.astype(np.int32), text)
        _, run, sizes = np.unique(g, return_inverse=True, return_counts=True)
        shared = sizes[run] > 1
        if shared.any():
            rows = Rows.of(batch.filter(pa.array(shared)))
            again = repeated_blocks(rows)
            which = np.flatnonzero(again)
            yield from _spans(rows, which, np.zeros(len(which), dtype=np.int32), rows.n[which] - 1, kind, gen)
            yield rows.take(np.flatnonzero(~again)).batch()
            batch = batch.filter(pa.array(~shared))
        yield batch

    def run(batches):
        w = kind.window
        for batch in slices(batches, kind.chunk):
            chunk, size = [], 0
            for doc, copy, text in zip(batch.column("doc").to_pylist(), batch.column("copy").to_pylist(), batch.column("text"), strict=True):
                raw, starts, ends, count = symbols(kind, text.as_buffer().to_pybytes() if text.is_valid else b"")
                whole = np.frombuffer(raw, dtype=np.uint8)
                for at in range(0, count - w + 1, kind.piece):
                    to = min(count, at + kind.piece + w - 1)
                    if kind.words:
                        base = int(starts[at])
                        s, e = starts[at:to] - base, ends[at:to] - base
                        lo, hi, anchor, h = blocks(kind, whole[base : int(ends[to - 1])], s, e)
                    else:
                        base = at
                        lo, hi, anchor, h = blocks(kind, whole[at:to], None, None)
                    if parts > 1:
                        mine = h % np.uint64(parts) == part
                        lo, hi, anchor, h = lo[mine], hi[mine], anchor[mine], h[mine]
                    first, last = (s[lo] + base, e[hi + w - 1] + base) if kind.words else (lo + base, hi + w + base)
                    same = np.ones(len(lo), dtype=np.int64)
                    chunk.append((h.view(np.int64), same * doc, same * copy, lo + at, hi - lo + 1, anchor - lo, [raw[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]))
                    size += int(last[-1] - first[0]) if len(lo) else 0
                    if size >= kind.chunk:
                        yield from sent(chunk)
                        chunk, size = [], 0
            yield from sent(chunk)

    return docs.select("doc", "copy", "text").mapInArrow(lean(run), ROWS)


def dealt(there: DataFrame, kind: Kind, gen: int, written: Written) -> DataFrame:
    """Spans (doc, copy, lo, hi) of generation gen, from a written table of what settle() gave; windows of very common anchors are dealt again until none is left."""

    def run(batches):
        yield from settle(batches, kind, gen)

    spans = []
    while True:
        spans.append(there.where("n = 0").select("doc", "copy", "lo", F.col("at").alias("hi")))
        more = there.where("n > 0")
        if more.isEmpty():
            break
        more = more.select(SCHEMA.names).repartition(shuffle_width(there.sparkSession), "g").sortWithinPartitions("g").mapInArrow(lean(run), ROWS)
        there = written.put(more, "spans")
    return union(spans)


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def repeated_spans(docs: DataFrame, kind: Kind, written: Written, passes: int = 1) -> DataFrame:
    """docs (doc, copy, text) -> the spans (doc, copy, lo, hi) of symbols, ends included, that windows repeat from earlier ones.

    passes: the first digit's values are taken in so many parts, one after another, which bounds what lies on disk.
    """

    def run(batches):
        yield from settle(batches, kind, 0)

    width = shuffle_width(docs.sparkSession)
    found = (scan(docs, kind, 0, p, passes).repartition(width, "g").sortWithinPartitions("g").mapInArrow(lean(run), ROWS) for p in range(passes))
    return union([dealt(written.put(rows, "spans"), kind, 0, written) for rows in found])


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """All rows as (doc, copy, text, rest: struct of the carried columns), and each (doc, copy, text) once.

    doc is the id, null as the largest. Rows that share an id are told apart by copy, their texts' hash, and follow each
    other in its order; rows that repeat both id and text are one document, and each gets that document's result.
    """
    rest = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("boolean")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("id"), rest.alias("rest"))
    repeated = rows.groupBy("doc").count().where("count > 1").select("doc", F.lit(True).alias("again"))
    if repeated.isEmpty():
        rows = rows.withColumn("copy", F.lit(0).cast("long"))
        return rows, rows.select("doc", "copy", "text")
    rows = rows.join(repeated, "doc", "left").withColumn("copy", F.when(F.col("again"), F.xxhash64("text")).otherwise(0)).drop("again")
    return rows, rows.select("doc", "copy", "text").dropDuplicates(["doc", "copy"])


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (doc, copy, ...) with spans: an array of (lo, hi), ends included, or null; spans overlap in any order."""
    listed = spans.groupBy("doc", "copy").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return docs.join(listed.hint("merge"), ["doc", "copy"], "left")  # spans grow with the input: never sent whole to every task


def covered(n: int, spans) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans (an Arrow list of lo, hi) as ascending, disjoint (starts, stops), stops excluded; touching ones are joined."""
    if spans is None or not spans.is_valid or not len(spans.values):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    depth = np.zeros(n + 1, dtype=np.int32)
    np.add.at(depth, spans.values.field("lo").to_numpy(), 1)
    np.subtract.at(depth, spans.values.field("hi").to_numpy() + 1, 1)
    on = np.r_[False, np.cumsum(depth)[:n] > 0, False]
    change = np.flatnonzero(on[1:] != on[:-1])
    return change[::2], change[1::2]
