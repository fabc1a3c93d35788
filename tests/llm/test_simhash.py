import random

import xxhash
from fixtures import corpus, frame
from pyspark.sql import functions as F

from maskwright.llm import simhash
from maskwright.llm.common import Written


def plain_fingerprint(text, k=3):
    parts = (text or "").encode().lower().split()
    grams = [b" ".join(parts)] if 0 < len(parts) <= k else [b" ".join(parts[i : i + k]) for i in range(len(parts) - k + 1)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: dict[int, int]) -> dict[int, int]:
    least = {i: i for i in prints}
    moved = True
    while moved:
        moved = False
        for a in prints:
            for b in prints:
                if least[b] < least[a] and (prints[a] ^ prints[b]).bit_count() <= 3:
                    least[a], moved = least[b], True
    return least


def test_against_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    prints = {r[0]: plain_fingerprint(r[1]) for r in rows}
    least = plain_components(prints)
    assert got == {i: (f"{prints[i]:016x}", least[i]) for i in prints}


def test_links_with_and_without_hot_buckets(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    want = {(a, b) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    df = spark.createDataFrame(signed, "fp long")
    for hot in (1, 3, 1000):
        assert {(r.a, r.b) for r in simhash.links(df, Written(spark), hot).collect()} == want


def test_empty_repeated_and_extra_columns(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    rows = spark.createDataFrame([(5, "a b c d", 1), (5, "a b c d", 2), (None, "z y x w v", 3), (7, None, 4)], "doc_id long, text string, fp int")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(rows.withColumn("id", F.lit(1)).withColumn("component", F.lit(2))).collect())
    assert got == [(0, 0), (5, 5), (5, 5), (7, 7)]


def test_parts_of_a_hot_key_are_not_held_together():
    """What a task holds of a key that is dealt to sixty parts is about one part."""
    import pyarrow as pa

    rows = [(k, p) for k, parts in ((1, 1), (2, 60), (3, 2)) for p in range(parts) for _ in range(100)]
    batches = [pa.RecordBatch.from_pydict({"key": [k for k, _ in rows[i : i + 30]], "part": pa.array([p for _, p in rows[i : i + 30]], pa.int32())}) for i in range(0, len(rows), 30)]
    tables = list(simhash._whole_parts(iter([*batches, batches[0].slice(0, 0)]), 50))
    assert [tuple(r.values()) for t in tables for r in t.to_pylist()] == rows and max(t.num_rows for t in tables) <= 160
    groups = [{(r["key"], r["part"]) for r in t.to_pylist()} for t in tables]
    assert sum(map(len, groups)) == len(set().union(*groups)) == 63
