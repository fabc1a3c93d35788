import hashlib
import math
import random

import duckdb
import numpy as np
from fixtures import corpus, frame, words
from pyspark.sql import functions as F

from maskwright.llm import itq, mixing, winnow


def test_winnowing_against_every_window():
    rng = random.Random(4)
    for n in (0, 1, 5, 7, 12, 40, 400):
        text = "".join(rng.choice("abé🙂") for _ in range(n)) if n < 400 else "ab" * 100 + "".join(rng.choice("ab") for _ in range(200))
        got = winnow.winnow(text, gram=5, window=8)
        window = min(8, max(1, n // 8))
        h = [] if not text else winnow.gram_hashes(np.r_[np.full(4, winnow.BEFORE, dtype=np.uint32), winnow.code_points(text)], 5).tolist()
        places = []
        for at in range(max(1, len(h) - window + 1) if h else 0):
            part = h[at : at + window]
            least = min(x >> 32 for x in part)
            places.append(at + max(i for i, x in enumerate(part) if x >> 32 == least))
        want = sorted(set(places))
        assert got[1].tolist() == [max(0, i - 4) for i in want] and got[0].tolist() == [h[i] for i in want]


def test_winnowing_in_pieces(monkeypatch):
    text = "".join(random.Random(2).choice("abc ") for _ in range(5000))
    whole = winnow.winnow(text)
    monkeypatch.setattr(winnow, "CHUNK", 300)
    assert [x.tolist() for x in winnow.winnow(text)] == [x.tolist() for x in whole]


def test_edit_report(spark):
    rows = corpus(n=60)
    got = {r.doc_id: r for r in winnow.edit_report(frame(spark, rows).repartition(5)).collect()}
    order = sorted((r[0], r[1] or "") for r in rows)
    print_of = lambda t: winnow.fingerprint_of(winnow.winnow(t)[0])
    assert len(got) == len(rows)
    for (d, t), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        q = len(t) // 4
        changed = t[: len(t) - q] + following[:q]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == print_of(t).tobytes().hex() and r.edited_fingerprint == print_of(changed).tobytes().hex()
        assert r.near_edited == winnow.likeness(print_of(t), print_of(changed)) and r.near_next == winnow.likeness(print_of(t), print_of(following))
    one = winnow.edit_report(frame(spark, [(3, "abcd" * 50, None, None, None)])).collect()
    assert one[0].near_next == 1.0 and winnow.edit_report(frame(spark, [])).count() == 0
    twice = winnow.edit_report(spark.createDataFrame([(1, "b"), (1, "a"), (None, None), (0, "c")], "doc_id long, text string").withColumn("part", F.lit(1))).collect()
    assert len(twice) == 4


def test_poisson_numbers_and_sql(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, f"text {i}", "en", f"s{0 if i % 3 else i % 7}" if i % 50 else None, 6) for i in range(3000)]
    rows += rows[:5]
    got = mixing.replicated(frame(spark, rows)).collect()
    counts = {}
    for r in got:
        counts[r.source] = counts.get(r.source, 0) + 1
    wanted = len(rows) / len({r[3] for r in rows})
    assert all(abs(n - wanted) < 6 * math.sqrt(wanted * 8) for n in counts.values())
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert sorted(map(str, con.execute(mixing.SQL).fetchall())) == sorted(str(tuple(r)) for r in got)
    weighted = mixing.replicated(frame(spark, rows), {"s0": 3.0, "s1": 1.0}).groupBy("source").count().collect()
    assert {r.source for r in weighted} == {"s0", "s1"}
    assert mixing.replicated(frame(spark, [])).count() == 0
    sums = spark.range(1).select(mixing.below(F.lit(2.5)).alias("s")).first().s
    assert all(abs(x - sum(math.exp(-2.5) * 2.5**j / math.factorial(j) for j in range(k + 1))) < 1e-12 for k, x in enumerate(sums))
    assert "Python" not in mixing.replicated(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    # a tiny source wanted often: a sum of several variables
    some = mixing.replicated(frame(spark, [(i, "t", "en", "big", 1) for i in range(1000)] + [(5000, "t", "en", "tiny", 1)])).where("source = 'tiny'").count()
    assert 350 < some < 650


def test_mixing_keeps_columns_of_any_name(spark):
    rows = frame(spark, [(i, "t", "en", f"s{i % 3}", 1) for i in range(300)])
    clash = ("random_order", "n_copies", "rate_source", "mean_copies", "rate", "mixed_source", "mixed_parts", "mixed_sums", "mixed_order", "u", "a.b")
    got = mixing.replicated(rows.withColumns({c: F.lit(c) for c in clash}).withColumn("copy", F.lit(-1)))
    assert set(got.columns) == {*rows.columns, *clash, "copy"}
    assert all(r[c] == c for r in got.collect() for c in clash)
    plain = {(r.doc_id, r["copy"]) for r in mixing.replicated(rows).collect()}
    assert {(r.doc_id, r["copy"]) for r in got.collect()} == plain
    dotted = mixing.replicated(rows.withColumnRenamed("source", "src.x").withColumnRenamed("doc_id", "id"), id_col="id", source_col="src.x").collect()
    assert {(r["id"], r["copy"]) for r in dotted} == plain and {r["src.x"] for r in dotted} == {"s0", "s1", "s2"}
    twice = mixing.replicated(spark.createDataFrame([(None, None), (None, None), (1, "s")], "doc_id long, source string"), {None: 1.0, "s": 1.0}).collect()
    assert all(r["copy"] >= 0 for r in twice)


def test_short_texts_are_like_their_edited_texts(spark):
    rng = random.Random(12)
    for n in (12, 20, 43, 90, 131, 400):
        near, far = [], []
        for _ in range(40):
            text, other = ("".join(rng.choice("abcdefghij klmnopq") for _ in range(n)) for _ in range(2))
            changed = winnow.edited(text, other)
            x, y, z = (winnow.fingerprint_of(winnow.winnow(t)[0]) for t in (text, changed, other))
            near.append(winnow.likeness(x, y))
            far.append(winnow.likeness(x, z))
        assert min(near) > 0.1 and 0.35 < np.mean(near) < 0.8 and np.mean(far) < 0.2, n


def test_likeness_has_no_steps_by_length(spark):
    """Texts of 1 to 140 code points against what is left without up to a quarter of their ends, and with another text there, however short."""
    rng = random.Random(21)
    word = lambda n: "".join(rng.choice("abcdefghij klmnopq") for _ in range(n))
    print_of = lambda t: winnow.fingerprint_of(winnow.winnow(t)[0])
    assert winnow.likeness(print_of("the quick brown fox jumps over the"), print_of("the quick brown fox jumps over the lazy")) > 0.5
    for n in range(1, 141):
        text = word(n)
        own = print_of(text)
        for cut in range(n // 4 + 1):
            assert winnow.likeness(own, print_of(text[: n - cut])) > 0.1, (n, cut)
        for m in (0, 1, 2, n // 8, n // 4, n):
            assert winnow.likeness(own, print_of(winnow.edited(text, word(m)))) > 0.1, (n, m)
            assert winnow.likeness(own, print_of("z" + word(max(n, 8)))) < 0.2
    rows = [(1, "a text of thirty-seven code points, a", None, None, None), (2, "bc", None, None, None)]
    assert winnow.edit_report(frame(spark, rows)).where("doc_id = 1").first().near_edited > 0.4


def test_matches_share_a_fingerprint_at_their_places(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdé🙂") for _ in range(n))
    match = word(winnow.GRAM + winnow.WINDOW - 1)
    rows = [(1, word(200) + match + word(50), None, None, None), (2, word(77) + match + word(300), None, None, None)]
    one, two = sorted(winnow.edit_report(frame(spark, rows)).collect())
    common = {(p.hash, p.position - 200) for p in one.positions} & {(p.hash, p.position - 77) for p in two.positions}
    assert any(0 <= at <= len(match) - winnow.GRAM for _, at in common)
    assert one.fingerprint == "".join(sorted({f"{p.hash:08x}" for p in one.positions}))


def test_edit_report_with_ties_of_one_id(spark):
    df = spark.createDataFrame([(1, "bbbbbbbb"), (1, "aaaaaaaa"), (2, "cccccccc"), (None, "dddddddd"), (None, "eeeeeeee")], "doc_id long, text string")
    df = df.withColumns({c: F.lit(1) for c in ("part", "beyond", "doc", "positions", "fingerprint", "held")})
    got = {r.fingerprint: r for r in winnow.edit_report(df).collect()}
    order = ["aaaaaaaa", "bbbbbbbb", "cccccccc", "dddddddd", "eeeeeeee"]
    for t, following in zip(order, [*order[1:], order[0]], strict=True):
        r = got[winnow.fingerprint_of(winnow.winnow(t)[0]).tobytes().hex()]
        assert r.edited_sha256 == hashlib.sha256((t[:6] + following[:2]).encode()).hexdigest()


def brute(vectors, cosine):
    ok = {i: v for i, v in vectors if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {i: np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) for i, v in ok.items()}
    links = {(a, b) for a in unit for b in unit if a != b and unit[a] @ unit[b] >= cosine}
    return links


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 8))
    vectors = [(i, v.tolist()) for i, v in enumerate(base)]
    vectors += [(200 + i, (base[i % 20] + 0.08 * rng.standard_normal(8)).tolist()) for i in range(120)]
    vectors += [(400 + i, base[3].tolist()) for i in range(12)] + [(500, (2 * base[3]).tolist()), (501, None), (502, [0.0] * 8), (503, [float("nan")] * 8), (504, [None] * 8), (505, [1.0, float("inf")] + [0.0] * 6), (506, []), (507, [-0.0] * 8), (508, [1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("id", F.lit(2))
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {r.vec_id: r for r in itq.near_duplicates(df, recall=0.995).collect()}
    links = brute(rows, 0.9)
    degree = {i: sum(a == i for a, _ in links) for i, _ in rows}
    assert len(got) == len(rows)
    assert all(got[i].n_links <= degree[i] for i in degree)
    assert sum(r.n_links for r in got.values()) >= 0.95 * len(links)
    exact = [400 + i for i in range(12)] + [3]
    assert len({got[i].component_id for i in exact}) == 1 and all(got[i].n_links >= 12 for i in exact)
    for i in (501, 502, 503, 504, 505, 506, 507, 508):  # the last one is the only one of its length
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    again = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id or 9, r.n_links, r.component_id) for r in itq.near_duplicates(again).collect()) == [(1, 0, 1), (1, 1, 1), (9, 1, 1)]
    assert itq.near_duplicates(df.limit(0)).count() == 0
    # with the recall of the query itself
    usual = {r.vec_id: r.n_links for r in itq.near_duplicates(df).collect()}
    assert all(n <= degree[i] for i, n in usual.items()) and sum(usual.values()) >= 0.95 * len(links)


def test_embeddings_that_share_a_direction(spark):
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    shared = unit(rng.standard_normal(64))
    x = unit(np.sqrt(0.7) * shared + np.sqrt(0.3) * unit(rng.standard_normal((600, 64))))
    y = unit(x + 0.44 * unit(rng.standard_normal((600, 64))))
    z = np.concatenate([x, y])
    vectors = [(i, v.tolist()) for i, v in enumerate(z)]
    links = int((z @ z.T >= 0.9).sum()) - len(z)
    got = itq.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    found = sum(r.n_links for r in got)
    assert links > 1000 and 0.95 * links <= found <= links


def test_vectors_of_every_length_are_linked(spark):
    rng = np.random.default_rng(8)
    vectors = []
    for dims, n in ((2, 60), (3, 40), (4, 40), (5, 40), (8, 200), (1, 3), (16, 2)):
        base = rng.standard_normal((n, dims))
        vectors += [v.tolist() for v in base] + [(v + 0.05 * rng.standard_normal(dims)).tolist() for v in base[: n // 2]]
    vectors += [[1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [1.0, 2.0], [1.0, 2.0, 3.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    unit = [np.array(v) / np.linalg.norm(v) for v in vectors]
    links = {(a, b) for a, x in enumerate(unit) for b, y in enumerate(unit) if a != b and len(x) == len(y) and x @ y >= 0.9}
    got = {r.vec_id: r for r in itq.near_duplicates(df, recall=0.999).collect()}
    degree = [sum(a == i for a, _ in links) for i in range(len(vectors))]
    assert len(got) == len(vectors) and all(got[i].n_links <= n for i, n in enumerate(degree))
    assert sum(r.n_links for r in got.values()) >= 0.99 * len(links)
    assert got[len(vectors) - 4].component_id == got[len(vectors) - 3].component_id
    assert all(len(vectors[r.component_id]) == len(vectors[i]) for i, r in got.items())
