import random

import numpy as np
import pytest
from fixtures import frame, words
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from maskwright.llm import bpe, simhash


def shingles(text, k=5):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def jaccard(x, y):
    return len(x & y) / len(x | y) if x or y else 1.0


def near_copies(seed=4):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(25):
        base = words(rng, rng.randint(60, 200))
        for k in range(rng.randint(1, 12)):
            ws = list(base)
            for _ in range(0 if k == 0 else rng.randint(0, 2)):
                ws[rng.randrange(len(ws))] = "edit"
            rows.append((i, " ".join(ws), "en", f"s{i % 4}", 1))
            i += 1
    return rows


def test_groups_of_similar_documents(spark, monkeypatch):
    rows = near_copies()
    sets = {r[0]: shingles(r[1]) for r in rows}
    least = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if jaccard(sets[a], sets[b]) >= 0.8:
                x, y = sorted((least[a], least[b]))
                least = {i: x if c == y else c for i, c in least.items()}
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(frame(spark, rows).repartition(3)).collect()}
    links = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    assert np.mean([got[a] == got[b] for a, b in links]) > 0.97
    assert all(jaccard(sets[i], sets[c]) > 0.4 for i, c in got.items())
    monkeypatch.setattr(simhash, "MOST_UNDER_KEY", 4)
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(frame(spark, rows)).collect()} == got


def test_links_are_of_shingle_sets(spark, monkeypatch):
    rng = random.Random(9)
    line = " ".join(words(rng, 10))
    bases = [words(rng, 104) for _ in range(30)]
    edits = [[*b[:90], *words(rng, 14)] for b in bases]  # 86 of 114 shingles in common: 0.75
    texts = [" ".join(x) for x in [*bases, *edits]] + [" ".join([*words(rng, 100), *[line] * 10]) for _ in range(4)] + [" ".join([*words(rng, 300), *[line] * 40]) for _ in range(4)]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    assert all(r.doc_id == r.component_id for r in simhash.similar_groups(frame(spark, rows)).collect())
    assert simhash.one_of_each(frame(spark, rows)).count() == len(rows)
    # a crowd around one text, at 0.86 of it and 0.75 of each other, with and without short runs
    base = words(rng, 204)
    crowd = [base] + [[*base[:k], *words(rng, 10), *base[k + 10 :]] for k in range(0, 200, 8)]
    sets = [shingles(" ".join(x)) for x in crowd]
    assert all(jaccard(sets[0], s) >= 0.8 for s in sets)
    for short in (2, 12):
        monkeypatch.setattr(simhash, "SHORT_RUN", short)
        got = simhash.similar_groups(frame(spark, [(i, " ".join(x), None, None, None) for i, x in enumerate(crowd)])).collect()
        assert {r.component_id for r in got} == {0}


def test_one_of_each_group(spark):
    rows = [*near_copies(), (900, None, None, None, None), (901, "", None, None, None), (902, "x", None, None, None), (903, "X", None, None, None), (5, "again", None, None, None)]
    kept = simhash.one_of_each(frame(spark, rows).withColumn("class", F.lit(1))).collect()
    ids = [r.doc_id for r in kept]
    assert len(ids) == len(set(ids)) and {900, 902} <= set(ids) and not {901, 903} & set(ids)
    assert simhash.one_of_each(frame(spark, [])).count() == 0


def test_one_of_each_with_null_and_repeated_ids(spark):
    rng = random.Random(5)
    a, b, c, d, e = (" ".join(words(rng, 60)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (None, c), (7, d), (7, e), (7, e), (3, d), (2, c)]
    kept = simhash.one_of_each(frame(spark, [(i, t, None, None, None) for i, t in rows])).collect()
    assert sorted(((r.doc_id or 0, r.text) for r in kept)) == sorted([(0, a), (0, b), (7, e), (3, d), (2, c)])


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    rows = near_copies() + [(500 + i, " ".join(w.upper() + "!!" for w in words(rng, 50)), "en", "bad", 1) for i in range(80)]
    passage = " ".join(words(rng, 55))
    rows += [(600 + i, " ".join([*words(rng, 40), passage, *words(rng, 30)]), None, "p", 1) for i in range(6)]
    labels = [(r[0], int(r[3] != "bad"), 0) for r in rows if r[0] % 3]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / f"out{k}")
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen[name] = docs.collect()
    first, second, third, fourth, last = seen.values()
    assert not any(r.source == "bad" for r in first) and len(first) > 0.95 * (len(rows) - 80)
    assert {r.doc_id for r in second} < {r.doc_id for r in first} and len(second) < 40
    assert sum(passage in r.text for r in third) == 1 and len(third) == len(second)
    assert all(r.n_chars == len(r.text) for r in third)
    before = {r.doc_id: r.text for r in second}
    assert sum(before[r.doc_id] == r.text for r in third) > len(third) - 12
    assert {r.doc_id for r in fourth} <= {r.doc_id for r in third}
    assert {(r.doc_id, r.text) for r in fourth} <= {(r.doc_id, r.text) for r in third}
    assert {r.doc_id for r in last} == {r.doc_id for r in fourth}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, whole)) == sorted(map(str, last))


def odd_rows():
    rng = random.Random(21)
    t, u, long = " ".join(words(rng, 60)), " ".join(words(rng, 45)), " ".join(words(rng, 20_000))
    return [(1, t, "en", "a", 1), (1, t, "en", "a", 1), (1, u, None, None, None), (None, u, "en", "b", 2), (None, None, None, "b", None), (None, "", None, None, 0), (2, None, None, None, None), (3, "", "en", "a", 0), (3, " \n", "en", "a", 2), (4, long, "de", "a", 5), (5, "x", "en", "c", 1), (5, "y", "en", "c", 1)]


@pytest.mark.parametrize("k", range(5))
def test_every_stage_on_odd_tables(spark, tmp_path, k):
    """Nulls, empty and very long texts, repeated rows and ids, clashing columns, an empty table: no crash, and a result that the docstrings define."""
    name, stage = corpus_pipeline.STAGES[k]
    rng = random.Random(2)
    train = [(100 + i, " ".join(words(rng, 40)) if i % 2 else "A!! B!! " * 20, "en", "a", 1) for i in range(80)]
    spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(train)] + [(None, 1, None), (1, None, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = odd_rows() + (train if k == 0 else [])
    clash = ("copy", "doc", "spans", "rest", "class", "id", "x", "score", "__id", "part", "g", "n_words", "least", "component")
    docs = frame(spark, rows).withColumns({c: F.lit(7) for c in clash})
    got = [r.asDict() for r in stage(spark, docs, str(tmp_path)).collect()]
    if k < 4:
        assert all(list(r) == list(corpus_pipeline.COLUMNS) for r in got)
        assert list(stage(spark, frame(spark, []), str(tmp_path)).columns) == list(corpus_pipeline.COLUMNS)
    assert stage(spark, frame(spark, []), str(tmp_path)).count() == 0
    pairs = [(r["doc_id"], r.get("text")) for r in got]
    given = [(r[0], r[1]) for r in rows]
    if name == "quality classifier":
        assert set(pairs) <= set(given) and all(pairs.count(p) == given.count(p) for p in set(pairs))
    elif name == "SimHash near-dedup":
        assert set(pairs) <= set(given) and len(pairs) == len(set(pairs))
        ids = {i: t for i, t in pairs if t and len(t) > 2}
        assert (1, rows[0][1]) in pairs and (4, rows[9][1]) in pairs and ids
        assert sorted(t.lower().split()[0] for _, t in pairs if t and t.split()) == sorted({t.lower().split()[0] for _, t in given if t and t.split()})
    elif name == "substring dedup":
        assert {i for i, _ in pairs} <= {i for i, _ in given} and (4, rows[9][1]) in pairs
        assert sum(t == rows[2][1] for _, t in pairs) == 1
    elif name == "mixing sources":
        assert set(pairs) <= set(given)
    else:
        library = Tokenizer.from_file(bpe.default_tokenizer())
        want = sorted((str(i), len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in given)
        assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in got if r["start"] == 0) == want
