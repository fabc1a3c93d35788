import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures import corpus, frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskwright.llm import bpe, packing

ODD = [
    "", " ", "Hello World, it's", "<|endoftext|>", "a<|startoftext|>b <|endoftext|>", "aaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000, "12345 6789", "ǅ İstanbul ß ΣΑΣ ſ", "é é Å", "日本語のテキスト 中文", "🙂🙂 👩‍👩‍👧 z",
    "a\x1cb\x1fc", "tab\tnew\nline\r\nx\x0by\x0cz", "a\x85b\xa0c d　e​f", "don't WE'LL i'm you're 'S'T", "!!!???...", "́ ́x", "\x00 \x7f", "ab" * 700 + " " + "ba" * 33, "ﬁ Ⅷ ²", "mixed1a2b3c", "﻿BOM", "हिन्दी ไทย",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


def test_counts_equal_the_library(spark, library):
    rng = random.Random(1)
    texts = ODD + [r[1] for r in corpus()] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x600), rng.randrange(0x900, 0xD7FF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(200)) for _ in range(60)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in bpe.token_counts(frame(spark, rows)).collect()}
    for i, t, *_ in rows:
        want = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), want, want > 2048), repr(t)[:200]


def equal_to(library, path, words):
    """Each word as a text of its own, and all of them in one."""
    lib, merge = bpe.Library(path), bpe.Merger(bpe.Library(path))
    ids, counts = bpe.Memory(packing.Encoder(lib), most=3), bpe.Memory(lambda words: merge.count_words(words).tolist(), most=3)
    for at in range(0, len(words), 4000):
        texts = words[at : at + 4000]
        texts += [" ".join(texts)]
        found, offsets = packing.encoded(pa.array(texts), lib, ids)
        own = bpe.Words.of(lib, pa.array(texts))
        value = np.array([*counts.values(own.parts), *(1 for _ in own.special), 0])
        n = [value[own.word[own.at[a:b]]].sum() for a, b in zip(own.offsets[:-1], own.offsets[1:], strict=True)]
        for t, a, b, count in zip(texts, offsets[:-1], offsets[1:], n, strict=True):
            want = library.encode(t, add_special_tokens=False).ids
            assert found[a:b].tolist() == want, ascii(t)
            assert count == len(want), ascii(t)


def test_words_by_their_parts(library):
    words = ["Word", "word.", "WORD,;", "word***", "Été!", "été", "ΑΣ", "ΑΣ.", "ας", "İx", "İx.", "ſ?", "a1.", "1.5", "don't.", "don't'", "s'%", "...", ".a", "é", "é.", "xΣ", "naïve:", "ß.", "ẞ.", "ﬀ.", "ǅ.", "<|endoftext|>", "<|endoftext|"]
    equal_to(library, bpe.default_tokenizer(), words + words[::-1])


def test_capitals_with_every_mark(library):
    """The normaliser composes before it lowers, so a lowered word must not be composed once more."""
    words = [f"{a}{c}{chr(m)}{z}" for m in range(0x300, 0x370) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÖΑΩ" for a, z in (("", ""), ("A", "a"), ("q", "."))]
    equal_to(library, bpe.default_tokenizer(), words)


def test_random_words(library):
    rng = random.Random(8)
    draw = lambda: chr(rng.choice([rng.randrange(33, 127), rng.randrange(0xC0, 0x250), rng.randrange(0x300, 0x370), rng.randrange(0x370, 0x600), rng.randrange(0x1E00, 0x2000), rng.randrange(0x3041, 0x3100), rng.randrange(0xAC00, 0xAC80), rng.randrange(0x1F300, 0x1F700)]))
    words = ["".join(draw() for _ in range(rng.randint(1, 9))) for _ in range(6000)]
    equal_to(library, bpe.default_tokenizer(), words)


def test_a_tokenizer_that_keeps_case(spark, tmp_path, library):
    spec = bpe.json.loads(library.to_str())
    spec["normalizer"]["normalizers"] = [n for n in spec["normalizer"]["normalizers"] if n["type"] != "Lowercase"]
    path = str(tmp_path / "cased.json")
    (tmp_path / "cased.json").write_text(bpe.json.dumps(spec))
    cased = Tokenizer.from_file(path)
    words = ["HELLO", "Hello.", "hello", "ÉTÉ!", "E\u0301TE", "ΑΣ", "A1***"]
    assert [len(cased.encode(w).ids) for w in ("HELLO", "hello")] == [5, 1]
    equal_to(cased, path, words)
    got = bpe.token_counts(frame(spark, [(0, " ".join(words), None, None, None)]), tokenizer=path).first()
    assert got.n_tokens == len(cased.encode(" ".join(words), add_special_tokens=False).ids)


def test_packing_does_not_depend_on_partitions(spark):
    rows = [*corpus(), (None, "again", None, None, None), (7, "again", None, None, None)]
    one, seven = (sorted(map(tuple, packing.pack(frame(spark, rows).repartition(n), capacity=64, group=50).collect()), key=str) for n in (1, 7))
    assert one == seven


def test_packing_with_clashing_columns_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (None, "c")], "doc_id long, text string")
    got = packing.pack(df.withColumns({c: F.lit("x") for c in ("group", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "id", "copy")})).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in got) == [(0, 1), (0, 2), (1, 3), (1, 3)]


def test_counts_empty_and_extra_columns(spark):
    assert bpe.token_counts(frame(spark, [])).count() == 0
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("n_tokens", "n_bytes", "id")})
    assert sorted(r.n_tokens for r in bpe.token_counts(df).collect()) == [0, 2, 2]


def test_tournament_tree_is_first_fit():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(1, 101, rng.integers(1, 200))
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        room, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            at = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
            if at == len(room):
                room.append(100)
            want[i] = (at, 100 - room[at])
            room[at] -= lengths[i]
        assert [(b, o) for b, o in zip(bins.tolist(), offsets.tolist(), strict=True)] == [want[i] for i in range(len(lengths))]


def test_packing_holds_every_id_once(spark, library):
    rows = [*corpus(), *((1000 + i, t, None, None, None) for i, t in enumerate(ODD)), (7, "again", None, None, None), (7, "again", None, None, None)]
    got = packing.pack(frame(spark, rows), capacity=64, group=50).collect()
    want = sorted((r[0], [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows)
    ids = {}
    for d, x in want:
        ids.setdefault(d, []).append(x)
    for d, texts in ids.items():
        pieces = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == d)
        assert pieces == sorted((s, len(x[s : s + 64]), zlib.crc32(np.array(x[s : s + 64], dtype="<u4").tobytes()), len(x)) for x in texts for s in range(0, len(x), 64))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    used = sum(r.length for r in got)
    assert len(bins) * 64 < used * 1.15
    assert packing.pack(frame(spark, [])).count() == 0
