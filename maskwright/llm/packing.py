"""Packing into fixed-length sequences: first-fit decreasing over a tournament tree, in randomised groups."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.bpe import CHUNK, Library, Memory, Words, byte_letters, default_tokenizer, memory_of
from maskwright.llm.common import lean, record_batch, slices
from maskwright.llm.repeats import mix

#: Documents that are packed together, on average.
GROUP = 4096
END_ID = 1


class Bins:
    """Bins of one capacity; the tree's nodes hold the most room of any bin below."""

    def __init__(self, capacity: int, most: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """Places size (at most the capacity) in the first bin with room; returns the bin, and the room that was left there."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        left = room[node]
        room[node] -= size
        at = node // 2
        while at:
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
            at //= 2
        return node - self.leaves, left


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, at most capacity; longer first, equal ones in their order."""
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int((lengths == capacity).sum())
    bins[order[:full]] = np.arange(full)
    if rest := order[full:].tolist():
        tree = Bins(capacity, len(rest))
        for i, size in zip(rest, lengths[rest].tolist(), strict=True):
            at, left = tree.put(size)
            bins[i], offsets[i] = full + at, capacity - left
    return bins, offsets


@lru_cache(maxsize=2)
def library(path: str) -> Library:
    return Library(path)


class Encoder:
    """Normalised words to their ids, many at a time, by the library.

    A word of letters only is one pre-token: a copy of the tokenizer that only splits at white space takes its byte
    letters, and its last id is known from the vocabulary's mark of a word's end. Where that doesn't come out even, and for
    all other words, a copy without the normaliser says itself where each id is from.
    """

    def __init__(self, lib: Library):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.normal, self.bare = Tokenizer.from_str(lib.tokenizer.to_str()), Tokenizer.from_str(lib.tokenizer.to_str())
        for t in (self.normal, self.bare):
            t.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab, end = lib.spec["model"]["vocab"], lib.spec["model"].get("end_of_word_suffix")
        self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocab.items() if end and t.endswith(end)]] = True
        self.plain = lib.plain and bool(end) and not lib.spec["model"].get("dropout")
        self.letters = byte_letters() | {32: " "}

    def __call__(self, words: list[str]) -> list[bytes]:
        out: dict[str, bytes] = {"": b""}
        if self.plain:
            self._letters([w for w in words if w.isalpha()], out)
        self._any([w for w in words if w not in out], out)
        return [out[w] for w in words]

    def _letters(self, words: list[str], out: dict[str, bytes]) -> None:
        if not words:
            return
        lines = [" ".join(words[i : i + 500]).encode().decode("latin-1").translate(self.letters) for i in range(0, len(words), 500)]
        ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)])
        ends = ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
        if len(ends) == len(words) and ends[-1] == 4 * len(ids):
            data = ids.tobytes()
            out.update(zip(words, [data[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def _any(self, words: list[str], out: dict[str, bytes]) -> None:
        """The library takes all words as one text, and says where each id is from."""
        if not words:
            return
        found = self.normal.encode(" ".join(words), add_special_tokens=False)
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        owner = np.searchsorted(starts, [a for a, _ in found.offsets], "right") - 1
        ends = (np.cumsum(np.bincount(owner.astype(np.int64), minlength=len(words))) * 4).tolist()
        ids = np.array(found.ids, dtype="<u4").tobytes()
        out.update(zip(words, [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, side by side."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(lengths.sum()))


def encoded(texts: pa.Array, lib: Library, memory: Memory) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts side by side, where each text's begin, with the end)."""
    words = Words.of(lib, texts)
    values = [*memory.values(words.parts), *(np.array([i], dtype="<u4").tobytes() for i in words.special), b""]
    sizes = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // 4
    data, starts = np.frombuffer(b"".join(values), dtype="<u4"), np.cumsum(sizes) - sizes
    # the ids of each different word, from those of its two parts, and then those of each place
    parts = words.word.ravel()
    data = data[_ragged(starts[parts], sizes[parts])]
    sizes = sizes[words.word].sum(axis=1)
    starts = np.cumsum(sizes) - sizes
    n = sizes[words.at]
    return data[_ragged(starts[words.at], n)], np.r_[0, np.cumsum(n)][words.offsets]


def pieces(docs: DataFrame, capacity: int, tokenizer: str, groups: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each piece: a document's ids and the end id, cut every capacity ids, dealt to a random group.

    The draw is a hash of seed, id, start, ids and the piece's place among equal pieces of its batch, so that repeated
    rows spread; but for rows that repeat both id and text it doesn't depend on partitions.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("group", pa.int64())])
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches):
        lib = library(tokenizer)
        memory = memory_of("ids", tokenizer, lambda: Memory(Encoder(lib)))
        for batch in slices(batches, CHUNK):
            if not batch.num_rows:
                continue
            ids, offsets = encoded(batch.column("text"), lib, memory)
            raw, rows, again = memoryview(ids.astype("<u4", copy=False).tobytes()), [], {}
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                n = b - a + 1
                for at in range(0, n, capacity):
                    to = min(at + capacity, n)
                    crc = zlib.crc32(raw[4 * (a + at) : 4 * (a + min(to, n - 1))])
                    rows.append((doc, at, to - at, zlib.crc32(end, crc) if to == n else crc, n))
            place = []
            for row in rows:
                place.append(again.get(row, 0))
                again[row] = place[-1] + 1
            columns = list(zip(*rows, strict=True))
            draw = mix(np.array([d or 0 for d in columns[0]], dtype=np.int64).view(np.uint64), np.array(columns[1], dtype=np.uint64))
            draw = mix(mix(draw, np.array(columns[3], dtype=np.uint64)), np.array(place, dtype=np.uint64))
            group = mix(draw, np.full(len(rows), seed, dtype=np.uint64)) % np.uint64(groups)
            yield record_batch(schema, *columns, group.astype(np.int64))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run, "ids"), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, `group` long")


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, group: int = GROUP, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and the end id; it is cut only every capacity ids, so each id lies in one piece. Pieces fill
    sequences first-fit, longest first, independently in random groups. A null or empty text is the end id alone. Repeated
    and null ids are documents of their own; an empty table gives an empty one; other columns are ignored.
    """
    groups = max(1, -(-docs.count() // group))
    cut = pieces(docs, capacity, tokenizer or default_tokenizer(), groups, seed, id_col, text_col)

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), capacity)
        return rows.drop(columns="group").assign(sequence_id=(int(rows["group"].iloc[0]) << 32) + bins, offset=offsets)

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
    return cut.groupBy("group").applyInPandas(fill, out)
