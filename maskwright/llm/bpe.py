"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
import os
import re
import string
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm import common
from maskwright.llm.common import lean, record_batch, slices

CHUNK = 8 << 20
#: So many different words are remembered at least, and twice as many at most.
MEMORY = 200_000
#: White space beyond ASCII, as the tokenizer's normaliser sees it.
_WIDE_SPACE = "[\u0085   -     　]"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(printable))
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Library:
    """A tokenizer whose pre-tokens never cross white space, and its special strings, which count wherever they stand."""

    def __init__(self, path: str):
        # a task has one core; threads of the library's own would only contend
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in self.spec.get("added_tokens", [])}
        self.special_pattern = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        steps = self.spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
        steps = steps.get("normalizers", [steps])
        self.lowers = any(x["type"] == "Lowercase" for x in steps)
        #: Words of ASCII only change their case.
        self.ascii_stays = all(x["type"] in ("NFC", "Lowercase") or x.get("pattern") == {"Regex": r"\s+"} for x in steps)
        split = self.spec.get("pre_tokenizer") or {"type": None}
        split = split.get("pretokenizers", [split])
        self.byte_level = any(x["type"] == "ByteLevel" and not x.get("add_prefix_space") for x in split)
        #: Letters are a pre-token, and so are marks behind them.
        self.plain = self.byte_level and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in str(split[0].get("pattern", {}).get("Regex"))

    def normalised(self, words: pa.Array) -> pa.Array:
        """The words as the library's normaliser leaves them."""
        normalizer = self.tokenizer.normalizer
        if normalizer is None or not len(words):
            return words
        out = pc.ascii_lower(words) if self.lowers else words
        wide = pc.invert(pc.string_is_ascii(words)) if self.ascii_stays else pa.array(np.ones(len(words), dtype=bool))
        some = words.filter(wide).to_pylist()
        if some:
            found = normalizer.normalize_str(" ".join(some)).split(" ")
            if len(found) != len(some):  # a word that the normaliser breaks up
                found = [normalizer.normalize_str(w) for w in some]
            out = pc.replace_with_mask(out, wide, pa.array(found, type=out.type))
        return out

    def spread(self, texts: pa.Array) -> pa.Array:
        """The texts with ASCII spaces for other white space and around special strings; null is the empty text."""
        texts = pc.fill_null(texts, "")
        for pattern, instead in ((_WIDE_SPACE, " "), (self.special_pattern, r" \0 ")):
            if pattern:
                odd = pc.match_substring_regex(texts, pattern)
                if pc.any(odd).as_py():
                    texts = pc.replace_with_mask(texts, odd, pc.replace_substring_regex(texts.filter(odd), pattern, instead))
        return texts


class Merger:
    """The merges of a BPE vocabulary as sorted arrays, applied to many sequences at a time."""

    def __init__(self, library: Library):
        model = library.spec["model"]
        vocab = model["vocab"]
        self.library, self.vocab, self.end = library, vocab, model.get("end_of_word_suffix") or ""
        self.width = len(vocab)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.letters = byte_letters()

    def _ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair, that of no merge if it has none, and what it makes."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys)), self.made[at]

    def counts(self, pre_tokens: list[str]) -> np.ndarray:
        """Symbols left of each pre-token (in the tokenizer's byte letters, none empty) when no pair has a rank.

        All sequences go on together: in each round every sequence joins, from the left, all places of its pair of lowest
        rank. A merge only makes pairs of higher rank, so this is what joining one pair at a time gives.
        """
        out = np.zeros(len(pre_tokens), dtype=np.int64)
        if not pre_tokens:
            return out
        vocab, end, none = self.vocab, self.end, len(self.keys)
        ids = np.array([vocab[c] for t in pre_tokens for c in (*t[:-1], t[-1] + end)], dtype=np.int64)
        owner = np.repeat(np.arange(len(pre_tokens)), [len(t) for t in pre_tokens])
        rank, makes, fresh = np.full(len(ids), none), np.zeros(len(ids), dtype=np.int64), np.ones(len(ids), dtype=bool)
        while len(ids):
            inner = np.r_[owner[1:] == owner[:-1], False]
            # only pairs with a new symbol are looked up
            ask = np.flatnonzero(inner & (fresh | np.r_[fresh[1:], False]))
            rank[~inner] = none
            rank[ask], makes[ask] = self._ranked(ids[ask], ids[ask + 1])
            starts = np.flatnonzero(np.r_[True, ~inner[:-1]])
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(ids)])
            done = least == none
            out[owner[starts[done]]] = sizes[done]
            picked = (rank == np.repeat(least, sizes)) & (rank < none)
            # of touching places (a symbol paired with itself) every second one is joined
            first = picked & ~np.r_[False, picked[:-1]]
            origin = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
            picked &= (np.arange(len(ids)) - origin) % 2 == 0
            ids = np.where(picked, makes, ids)
            keep = ~np.r_[False, picked[:-1]] & np.repeat(~done, sizes)
            ids, owner, rank, makes, fresh = ids[keep], owner[keep], rank[keep], makes[keep], picked[keep]
        return out

    def count_words(self, words: list[str]) -> np.ndarray:
        """Tokens of each normalised word."""
        out = np.zeros(len(words), dtype=np.int64)
        alone = [i for i, w in enumerate(words) if self.library.plain and w.isalpha()]
        out[alone] = self.counts([words[i].encode().decode("latin-1").translate(self.letters) for i in alone])
        others = sorted(set(range(len(words))).difference(alone))
        split = self.library.tokenizer.pre_tokenizer.pre_tokenize_str if self.library.tokenizer.pre_tokenizer else lambda t: [(t, (0, len(t)))]
        pre = [[t for t, _ in split(words[i])] for i in others]
        owner = np.repeat(others, [len(p) for p in pre]).astype(np.int64)
        np.add.at(out, owner, self.counts([t for p in pre for t in p]))
        return out


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(Library(path))


class Memory:
    """What has been worked out for parts of words; each stays for as long as two generations of most parts last."""

    def __init__(self, work, most: int = MEMORY):
        self.work, self.most, self.known, self.old = work, most, {}, {}

    def values(self, parts: list[str]) -> list:
        """The value of each of some different parts."""
        if len(self.known) > self.most:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        new = []
        for p in parts:
            if p not in known:
                if p in old:
                    known[p] = old[p]
                else:
                    new.append(p)
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            known.update(zip(some, self.work(some), strict=True))
        return [known[p] for p in parts]


@dataclass
class Words:
    """The words of some texts. Each is one or two parts, the second of which may be empty; a special string is one of its own.

    parts: the different parts, normalised; special: the ids of the parts that follow them; word: the parts of each
    different word; at: the word at each place; offsets: where each text begins, with the end.
    """

    parts: list[str]
    special: list[int]
    word: np.ndarray
    at: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, library: Library, texts: pa.Array) -> Words:
        split = pc.ascii_split_whitespace(library.spread(texts))
        offsets = split.offsets.to_numpy().astype(np.int64)
        found = split.flatten().dictionary_encode()
        different, n = found.dictionary, len(found.dictionary)
        normal = library.normalised(different)
        normal = normal.combine_chunks() if isinstance(normal, pa.ChunkedArray) else normal
        if normal.offset:
            normal = pa.concat_arrays([normal])
        _, places, data = normal.buffers()
        ends = np.zeros(2 * n + 1, dtype=np.int32)
        ends[::2] = np.frombuffer(places, dtype=np.int32)[: n + 1] if n else 0
        ends[1::2] = ends[2::2]
        if library.plain and n:
            # marks behind a letter or number are a pre-token of their own
            core = pc.ascii_rtrim(normal, characters=string.punctuation)
            size = pc.binary_length(core).to_numpy()
            cut = np.flatnonzero((size > 0) & (size < np.diff(ends[::2])))
            cut = cut[pc.match_substring_regex(core.take(pa.array(cut)), r"[\p{L}\p{N}]$").to_numpy(zero_copy_only=False)]
            ends[2 * cut + 1] = ends[2 * cut] + size[cut]
        parts = pa.StringArray.from_buffers(2 * n, pa.py_buffer(ends), data).dictionary_encode()
        word = parts.indices.to_numpy().astype(np.int64).reshape(n, 2)
        special = []
        if library.special:
            for i in np.flatnonzero(pc.is_in(different, value_set=pa.array(list(library.special))).to_numpy(zero_copy_only=False)):
                word[i] = len(parts.dictionary) + len(special), len(parts.dictionary) + len(library.special)
                special.append(library.special[different[int(i)].as_py()])
        word[word == len(parts.dictionary) + len(library.special)] = len(parts.dictionary) + len(special)
        return cls(parts.dictionary.to_pylist(), special, word, found.indices.to_numpy(), offsets - offsets[0])


def memory_of(purpose: str, path: str, make) -> Memory:
    """The memory of this Python worker, which outlives a task."""
    kept = common.REMEMBERED.setdefault(purpose, {})
    if path not in kept:
        kept[path] = make()
    return kept[path]


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), without begin or end tokens, of whole texts.

    Null and empty texts have no tokens; special strings inside texts are single tokens, as the library takes them.
    Repeated and null ids keep their rows; an empty table gives an empty one; other columns are ignored. tokenizer is the
    path of a BPE vocabulary whose pre-tokens never cross white space, readable on every executor.
    """
    path = tokenizer or default_tokenizer()
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        merge = merger(path)
        memory = memory_of("counts", path, lambda: Memory(lambda words: merge.count_words(words).tolist()))
        for batch in slices(batches, CHUNK):
            words = Words.of(merge.library, batch.column("text"))
            of_parts = np.array([*memory.values(words.parts), *(1 for _ in words.special), 0], dtype=np.int64)
            sums, offsets = np.r_[0, np.cumsum(of_parts[words.word].sum(axis=1)[words.at])], words.offsets
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield record_batch(schema, batch.column("doc_id"), sizes, sums[offsets[1:]] - sums[offsets[:-1]])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run, "counts"), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
