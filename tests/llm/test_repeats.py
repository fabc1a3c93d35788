import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures import corpus, frame, words
from pyspark.sql import functions as F

from maskwright.llm import repeats, substring, suffix
from maskwright.llm.common import Written


def plain(rows, symbols, w):
    """{doc_id: removed flags}: each window looked up among all earlier ones."""
    seen, out = set(), {}
    for doc, text in sorted({(r[0], r[1] or "") for r in rows}):
        s = symbols(text)
        gone = [False] * len(s)
        for p in range(len(s) - w + 1):
            key = tuple(s[p : p + w]) if isinstance(s, list) else s[p : p + w]
            if key in seen:
                gone[p : p + w] = [True] * w
            seen.add(key)
        out[doc] = (s, gone)
    return out


def word_result(rows, w=20):
    out = {}
    for doc, (s, gone) in plain(rows, lambda t: t.encode().split(), w).items():
        kept = b" ".join(x for x, g in zip(s, gone, strict=True) if not g)
        out[doc] = (len(s), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def byte_result(rows, w=100):
    out = {}
    for doc, (s, gone) in plain(rows, lambda t: t.encode(), w).items():
        runs = sum(g and not before for g, before in zip(gone, [False, *gone], strict=False))
        out[doc] = (len(s), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(s, gone, strict=True) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_words_against_brute_force(spark, batches):
    rows = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.removed(frame(spark, rows).repartition(3), batches=batches, fanout=2).collect()}
    want = word_result(rows)
    assert got == want
    assert sum(x[1] for x in want.values()) > 1000


def test_bytes_against_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removed(frame(spark, rows).repartition(3)).collect()}
    assert got == byte_result(rows)


def flags(rows, spans):
    got = {r[0]: [False] * len(r[1]) for r in rows}
    for r in spans.collect():
        got[r.doc][r.lo : r.hi + 1] = [True] * (r.hi + 1 - r.lo)
    return got


def test_small_windows_pieces_and_runs_of_one_symbol(spark):
    rng = random.Random(5)
    texts = ["ab" * 40, "a" * 90, "a" * 70 + "b" * 30, "".join(rng.choice("ab") for _ in range(400)), "".join(rng.choice("abc") for _ in range(300))]
    texts += [texts[3][50:220] + "c" + texts[4][10:90], texts[4][::-1], "b" + texts[0]]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    _, docs = repeats.keyed(frame(spark, rows).repartition(3))
    for w, gram, piece, passes in ((12, 4, 50, 2), (8, 3, 1000, 1), (30, 30, 64, 1), (3, 1, 40, 1)):
        kind = repeats.Kind(False, window=w, gram=gram, piece=piece, chunk=150)
        assert flags(rows, repeats.repeated_spans(docs, kind, Written(spark), passes)) == {d: g for d, (_, g) in plain(rows, lambda t: t.encode(), w).items()}


@pytest.mark.parametrize("held", [1, 3000, 40_000])
def test_common_anchors_are_opened(spark, held):
    """With little room for the rows of an anchor their windows are dealt one by one, and the result is the same."""
    rng = random.Random(11)
    core = "".join(rng.choice("abcdefgh") for _ in range(60))
    rows = [(i, "".join(rng.choice("ab") for _ in range(30)) + core + "".join(rng.choice("ab") for _ in range(30)), None, None, None) for i in range(300)]
    rows += [(1000 + i, rows[i % 7][1][5:110], None, None, None) for i in range(60)]
    _, docs = repeats.keyed(frame(spark, rows).repartition(5))
    kind = repeats.Kind(False, window=70, gram=20, chunk=2000, held=held)
    assert flags(rows, repeats.repeated_spans(docs, kind, Written(spark))) == {d: g for d, (_, g) in plain(rows, lambda t: t.encode(), 70).items()}


def test_classes_are_those_of_equal_bytes():
    rng = random.Random(3)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.choice((1, 4, 5, 6, 11)))) for _ in range(400)] + [bytes(20)] * 3
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    length = np.array([len(t) for t in texts])
    classes = repeats.equal_classes(length, np.cumsum(length) - length, length, data)
    by = {}
    for t, c in zip(texts, classes.tolist(), strict=True):
        by.setdefault(t, set()).add(c)
    assert all((c == {-1}) == (texts.count(t) == 1) and len(c) == 1 for t, c in by.items())
    assert len({min(c) for c in by.values() if c != {-1}}) == sum(c != {-1} for c in by.values())


def test_hashes_of_long_words_do_not_depend_on_parts():
    long = bytes(range(33, 120)) * 9000  # longer than a part
    data = np.frombuffer(b"x " + long + b" yy", dtype=np.uint8)
    starts, ends = np.array([0, 2, 3 + len(long)]), np.array([1, 2 + len(long), 5 + len(long)])
    whole = repeats.word_hashes(data, starts, ends)
    power, total = 1, 0
    for b in long:
        total = (total + int(repeats._BYTES[b]) * power) % 2**64
        power = power * int(repeats._A) % 2**64
    one = np.array([total], dtype=np.uint64)
    assert whole[1] == repeats.mix(one, one)[0]
    assert whole[2] == repeats.word_hashes(np.frombuffer(b"yy", dtype=np.uint8), np.array([0]), np.array([2]))[0]


def test_an_index_is_compacted_and_goes_on_in_a_later_session(spark, tmp_path):
    rows = corpus(seed=13)
    _, docs = repeats.keyed(frame(spark, rows).repartition(3))
    path, spans = f"file://{tmp_path}/index", []
    parts = substring.batches_by_id(docs, 5)
    for k, part in enumerate(parts):
        index = substring.Index(spark if k % 2 else spark.newSession(), path, fanout=2)
        assert index.generations == k
        assert len(index.runs) <= 2
        spans.append(index.add(part))
    want = {d: [i for i, x in enumerate(g) if x] for d, (_, g) in plain(rows, lambda t: t.encode().split(), 20).items()}
    got = {}
    for s in spans:
        for r in s.collect():
            got.setdefault(r.doc, set()).update(range(r.lo, r.hi + 1))
    assert {d: sorted(x) for d, x in got.items()} == {d: x for d, x in want.items() if x}
    with pytest.raises(ValueError):
        substring.Index(spark, path, window=10)
    index.delete()
    assert substring.Index(spark, path).generations == 0


def test_history_is_read_where_it_lies(spark):
    """Only a new generation's own blocks are shuffled; a union of runs alone keeps their buckets."""
    _, docs = repeats.keyed(frame(spark).repartition(3))
    index = substring.Index(spark)
    one, two, three = substring.batches_by_id(docs, 3)
    index.add(one)
    index.add(two)
    new = index._slotted(repeats.scan(three, index.kind, 2)).repartition(index.buckets, "own_slot")
    plan = index._merged(index._aligned([*map(index._blocks, index.runs), new]), lambda batches: batches)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2 and plan.count("Exchange hashpartitioning(own_slot") == 1
    # of runs alone, each slot is one group, with nothing shuffled
    firsts = index._merged(index._aligned(list(map(index._blocks, index.runs))), lambda batches: [pa.concat_batches([pa.RecordBatch.from_arrays(b.columns, names=b.schema.names) for b in batches]).slice(0, 1)])
    assert "Exchange" not in firsts._jdf.queryExecution().executedPlan().toString()
    slots = [r.slot for r in firsts.collect()]
    assert len(slots) == len(set(slots)) > 20
    index.delete()


def test_generations_whose_repeats_lie_inside_one_chunk(spark):
    rng = random.Random(9)
    base = [words(rng, 120) for _ in range(6)]
    rows = []
    for i in range(40):
        ws = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            ws[rng.randrange(len(ws))] = rng.choice(["p", "q", "r"])
        rows.append((i, " ".join(ws), None, None, None))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.removed(frame(spark, rows).repartition(1), batches=4, fanout=2).collect()}
    assert got == word_result(rows)


def test_empty_repeated_null_ids_and_extra_columns(spark):
    assert substring.removed(frame(spark, [])).count() == 0
    assert suffix.removed(frame(spark, [])).count() == 0
    t = " ".join(words(random.Random(1), 30))
    df = spark.createDataFrame([(2, t), (1, t), (1, t), (1, "z " + t), (None, t), (None, None)], "doc_id long, text string").withColumns({c: F.lit(3) for c in ("doc", "copy", "g", "lo", "spans", "id", "rest")})
    got = sorted((r.doc_id or 99, r.n_words, r.n_removed) for r in substring.removed(df, carry=("doc", "spans")).collect())
    twice = [x for x in got if x[0] == 1]
    assert got[3:] == [(2, 30, 30), (99, 0, 0), (99, 30, 30)]
    assert twice in ([(1, 30, 0), (1, 30, 0), (1, 31, 30)], [(1, 30, 30), (1, 30, 30), (1, 31, 0)])
