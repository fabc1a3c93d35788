import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from fixtures import corpus
from pyspark.sql import functions as F

from maskwright.llm import collocations as C


def plain(rows, least, longest, share, top):
    """Every phrase counted by itself, in Python's integers."""
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            ws = re.findall("[^ \t]+", piece)
            for n in range(1, longest + 1):
                counts["und" if lang is None else lang].update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = defaultdict(int)
        for p, a in found.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inside[p[i : i + n]] = max(inside[p[i : i + n]], a)
        rows = []
        for p, a in found.items():
            if 100 * inside[p] >= share * a and inside[p]:
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        total = sum(a for p, a in f.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, left, right, total, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def texts(n=400, seed=3):
    rng = random.Random(seed)
    words = ["a", "the", "Of", "rare", "Émile", "x1", "in", " ", "日本", "\x00", "b", "c"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(words[: 3 + i % 10]) + rng.choice(" \t  ., \n;\r\n!?:") for _ in range(rng.randint(0, 30)))
        out.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), text))
    return out + [("en", None), (None, None), ("fr", ""), ("fr", " ., "), ("it", "w" * 5000 + " "), ("en", "hot hot hot " * 700)] + [("en", "a hot passage that is in many texts")] * 60


def frame(spark, rows):
    clash = {c: F.lit(1) for c in ("word", "f", "h", "key", "a", "n", "rank", "phrase", "bucket", "at")}
    return spark.createDataFrame(rows, "lang string, text string").withColumns(clash)


@pytest.mark.parametrize(("least", "longest", "share", "top", "hot"), [(10, 3, 50, 2000, C.HOT), (3, 3, 50, 40, 50), (2, 4, 80, 2000, 20), (2, 2, 50, 2000, 1), (1, 5, 30, 300, 10)])
def test_against_every_phrase(spark, least, longest, share, top, hot):
    rows = texts()
    got = C.collocations(frame(spark, rows).repartition(5), least, longest, share, top, hot=hot).collect()
    assert sorted(map(tuple, got)) == plain(rows, least, longest, share, top)


def test_small_pieces_of_work(spark, monkeypatch):
    rows = [(r[2], r[1]) for r in corpus(n=80)]
    monkeypatch.setattr(C, "SLOTS", 8)  # many words in one place
    assert sorted(map(tuple, C.collocations(frame(spark, rows), 3).collect())) == plain(rows, 3, 3, 50, 2000)


def test_empty_tables_and_arguments(spark):
    assert C.collocations(frame(spark, [])).count() == 0
    assert C.collocations(frame(spark, [("en", "one two three")])).count() == 0
    for bad in ({"longest": 1}, {"least": 0}):
        with pytest.raises(ValueError):
            C.collocations(frame(spark, []), **bad)


def test_sql(spark, tmp_path):
    rows = texts(300, 5)
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(con.execute(C.sql(4)).fetchall()) == plain(rows, 4, 3, 50, 2000)


def test_products_beyond_64_bits(spark):
    singles = spark.createDataFrame([(1, 3_000_000_000_019), (2, 3_000_000_000_007)], "h long, f long")
    phrases = spark.createDataFrame([([1, 2], 2_999_999_999_999)], "key array<long>, a long")
    row = C.scored(phrases, singles, 3).first()
    assert row.score == 1_000_000 * 2_999_999_999_999**2 // (3_000_000_000_019 * 3_000_000_000_007)


def test_a_phrase_belongs_to_its_rarest_word_once():
    rng = np.random.default_rng(1)
    rank = rng.integers(-1, 4, 500).astype(np.int32)
    places = C.fragments_of(rank, 3)
    seen = Counter()
    for row in places:
        for size in (2, 3):
            for first in range(3 - size, 3):
                part = row[first : first + size]
                if (part >= 0).all():
                    seen[tuple(part.tolist())] += 1
                    assert rank[row[2]] == rank[part].min()
    want = {tuple(range(i, i + n)) for n in (2, 3) for i in range(500 - n + 1) if (rank[i : i + n] >= 0).all()}
    assert set(seen) == want and set(seen.values()) == {1}


def test_long_texts_are_cut_at_pieces():
    import pyarrow as pa

    text = "Word one. " * 500 + "x" * 3000 + ", end"
    batch = pa.RecordBatch.from_pylist([{"lang": "en", "text": text}, {"lang": "en", "text": None}, {"lang": "de", "text": "b a"}])
    got = list(C._by_lang([batch], 1000))
    assert b"".join(d for lang, d in got if lang == "en") == text.lower().replace(".", "\n").replace(",", "\n").encode() and ("de", b"b a") in got
