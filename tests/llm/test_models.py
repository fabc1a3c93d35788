import random
import zlib

import numpy as np
from fixtures import frame, words
from pyspark.sql import functions as F

from maskwright.llm import quality, textstats, toxicity


def labelled(n=900):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        ws = words(rng, rng.randint(30, 80))
        good, toxic = i % 4 != 0, i % 5 == 1
        if not good:
            ws = [w.upper() + "!!" for w in ws] if i % 8 else [ws[0]] * 60
        if toxic:
            ws.insert(rng.randrange(len(ws)), rng.choice(["vilest", "vilely", "horrid", "Horrid,"]))
        docs.append((i, " ".join(ws), "en", "s", 1))
        if i % 3:
            labels.append((i, int(good), int(toxic)))
    return docs, labels


def auc(rows, truth):
    pos, neg = ([r.score for r in rows if r.held_out and truth[r.doc_id] == y] for y in (1, 0))
    return np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])


def test_quality_and_toxicity_on_held_out_rows(spark):
    docs, labels = labelled()
    df, known = frame(spark, docs).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = quality.classified(df, known).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert auc(rows, {d[0]: int(d[0] % 4 != 0) for d in docs}) > 0.98
    rows = toxicity.classified(df, known).collect()
    assert auc(rows, {d[0]: int(d[0] % 5 == 1) for d in docs}) > 0.98
    again = {r.doc_id: r.score for r in toxicity.classified(df.repartition(7), known).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in rows)


def test_nothing_to_learn_from(spark):
    docs = [(1, None, None, None, None), (2, "", None, None, None), (None, "x " * 9000, None, None, None), (2, "a", None, None, None)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, nulls):
        for classified in (quality.classified, toxicity.classified):
            rows = classified(frame(spark, docs), labels).collect()
            assert len(rows) == 4 and len({round(r.score, 9) for r in rows}) == 1
            assert classified(frame(spark, []), labels).count() == 0


def test_forest_against_its_trees():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.boost(x, y, trees=40, depth=3)
    got = forest.margin(x)
    for i in range(0, 600, 37):
        total = forest.base
        for t in range(len(forest.feature)):
            at = 0
            while forest.left[t, at] != at:
                at = forest.left[t, at] + int(x[i, forest.feature[t, at]] > forest.cut[t, at])
            total += forest.value[t, at]
        assert abs(total - got[i]) < 1e-9
    assert ((forest.probability(x) > 0.5) == (y > 0.5)).mean() > 0.97


def test_boosting_against_plain_loops():
    """The first tree's root takes the split of most gain among all cuts between bins, and its leaves the Newton step."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = ((x[:, 1] > 6) | (rng.random(300) < 0.1)).astype(float)
    forest = quality.boost(x, y, trees=1, depth=1, rate=0.1, l2=1.0, least=10)
    p = y.mean()
    grad, hess = p - y, np.full(300, p * (1 - p))
    best = (0.0, None, None)
    for f in range(3):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])):
            left = x[:, f] <= cut
            if 10 <= left.sum() <= 290:
                parts = [grad[m].sum() ** 2 / (hess[m].sum() + 1) for m in (left, ~left)]
                gain = sum(parts) - grad.sum() ** 2 / (hess.sum() + 1)
                if gain > best[0] + 1e-9:
                    best = (gain, f, cut)
    assert (forest.feature[0, 0], forest.cut[0, 0]) == best[1:]
    left = x[:, best[1]] <= best[2]
    leaf = forest.left[0, 0]
    assert np.allclose(forest.value[0, [leaf, leaf + 1]], [-0.1 * grad[m].sum() / (hess[m].sum() + 1) for m in (left, ~left)])


def test_toxicity_against_plain_loops(spark):
    """Corpus counts, vocabulary and scores as plain Python works them out."""
    docs, labels = labelled(300)
    df, known = frame(spark, docs).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = {d[0]: zlib.crc32(str(d[0]).encode()) % 5 == 0 for d in docs}
    features = {d[0]: {f for w in toxicity.words(d[1]) for f in toxicity.features_of(w)} for d in docs}
    got = {r.feature: r.u for r in toxicity.corpus_counts(df.where("doc_id % 2 = 0"), ["^vile", "^vil", "^nowhere"]).collect()}
    even = [features[i] for i in features if i % 2 == 0]
    every = {f for fs in even for f in fs if not f.startswith("^") or f in ("^vile", "^vil")}
    assert got == {None: 150} | {f: sum(f in fs for fs in even) for f in every}
    model = toxicity.train(df, known)
    toxic = [i for i, _, t in labels if t and not held[i]]
    free = [i for i in features if not held[i]]
    share = lambda f, rows: sum(f in features[i] for i in rows) / len(rows)

    def far(f):
        p, u = share(f, toxic), share(f, free)
        return abs(p - u) / ((p * (1 - p) + 0.5 / len(toxic)) / len(toxic) + (u * (1 - u) + 0.5 / len(free)) / len(free)) ** 0.5

    every = set().union(*features.values())
    every = {f for f in every if not f.startswith("^") or sum(f in features[i] for i in toxic) >= 5}
    want = {f for f in every if sum(f in features[i] for i in toxic) + sum(f in features[i] for i in free) >= 5 and far(f) >= toxicity.LEAST_Z}
    assert set(model.weights) == want and {"^vile", "horrid"} <= want
    rows = toxicity.classified(df, known).collect()
    for r in rows:
        z = model.base + sum(w for f, w in model.weights.items() if f in features[r.doc_id])
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-6


def test_the_estimators_gradient():
    """A step goes along the numeric gradient of the corrected risk, or up that of the negative part where it is below zero."""
    rng = np.random.default_rng(7)
    xp, xu = (rng.random((40, 5)) < 0.5).astype(float), (rng.random((90, 5)) < 0.4).astype(float)
    w, base = toxicity.non_negative_pu(xp, xu, 0.3, rounds=1, rate=0.05, l2=0.0)
    start = float(np.log(0.3 / 0.7))

    def risk(v):
        s = lambda x: 1 / (1 + np.exp(-(x @ v[:-1] + v[-1])))
        negative = -np.log(1 - s(xu)).mean() + 0.3 * np.log(1 - s(xp)).mean()
        return -0.3 * np.log(s(xp)).mean() + negative if negative >= 0 else -negative

    zero = np.r_[np.zeros(5), start]
    gradient = np.array([(risk(zero + e) - risk(zero - e)) / 2e-6 for e in np.eye(6) * 1e-6])
    assert np.allclose(np.r_[w, base] - zero, -0.05 * np.sign(np.where(abs(gradient) < 1e-8, 0, gradient)), atol=1e-3)  # at its start the base has no slope


def test_repeated_rows_and_clashing_columns(spark):
    docs, labels = labelled(200)
    clash = {c: F.lit("x") for c in ("score", "predicted", "held_out", "y", "x", "id", "rest", "words", "confirmed", "free", "word", "at", "n")}
    known = spark.createDataFrame(labels + labels[:50], "doc_id long, quality int, toxic int")
    for classified in (quality.classified, toxicity.classified):
        twice = classified(frame(spark, docs + docs[:20]).withColumns(clash), known.withColumns({c: F.lit(1) for c in ("y", "confirmed", "id")})).collect()
        once = {r.doc_id: r.score for r in classified(frame(spark, docs), known).collect()}
        assert len(twice) == 220 and all(0 <= r.score <= 1 for r in twice)
        assert np.mean([abs(once[r.doc_id] - r.score) for r in twice]) < 0.05
    # many rows of one sampled id bring one text of it
    many = frame(spark, docs + [(1, f"text {i}", None, None, None) for i in range(500)])
    assert toxicity.classified(many, known, most_positive=5).count() == 700


def test_all_unlabelled_texts_count(spark):
    """Sums over all rows as a plain loop has them; steps lower the risk over all rows, which the first sample isn't like."""
    rng = np.random.default_rng(9)
    rare, usual = np.array([0.8, 0.2, 0.3, 0.4, 0.5, 0.1]), np.array([0.1, 0.2, 0.3, 0.4, 0.05, 0.5])
    x, xp = (rng.random((500, 6)) < np.where(np.arange(500)[:, None] % 10 == 0, rare, usual)).astype(float), (rng.random((200, 6)) < rare).astype(float)
    lists = spark.createDataFrame([(np.flatnonzero(r).tolist(),) for r in x], "at array<int>").repartition(5)
    w, base = rng.standard_normal(6), -0.5
    g, h, risk = toxicity.unlabelled_sums(lists, w, base)
    s, wide = 1 / (1 + np.exp(-(x @ w + base))), np.c_[x, np.ones(500)]
    assert np.allclose(g, s @ wide) and np.allclose(h, (s * (1 - s) * wide.sum(axis=1)) @ wide) and np.isclose(risk, -np.log(1 - s).sum())

    def whole(w, base):
        s, sp = (1 / (1 + np.exp(-(m @ w + base))) for m in (x, xp))
        return -0.1 * np.log(sp).mean() + max(0, -np.log(1 - s).mean() + 0.1 * np.log(1 - sp).mean())

    w, base = toxicity.non_negative_pu(xp, x[:60], 0.1)
    steps = [toxicity.corrected(w, base, xp, lists, 500, 0.1, n) for n in (1, 8)]
    best = whole(*toxicity.non_negative_pu(xp, x, 0.1, rounds=3000, rate=0.01))
    assert best < whole(*steps[1]) < whole(*steps[0]) < whole(w, base) and whole(*steps[1]) - best < 0.1 * (whole(w, base) - best)
    docs, labels = labelled(300)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    few, all_ = (toxicity.train(frame(spark, docs), known, first_unlabelled=n) for n in (20, 300))
    assert set(few.weights) == set(all_.weights)


def test_statistics_of_odd_texts():
    for t in ("", " ", "\n\n", "x", "é" * 10, "A!! B!!", "🙂", "a" * 100000):
        got = textstats.statistics(t)
        assert len(got) == len(textstats.NAMES) and np.isfinite(got).all()


def test_risk_estimator_stays_calm():
    rng = np.random.default_rng(0)
    xp = (rng.random((60, 30)) < 0.1).astype(np.float32)
    xp[:, 0] = 1
    xu = (rng.random((400, 30)) < 0.1).astype(np.float32)
    xu[:40, 0], xu[40:, 0] = 1, 0
    w, base = toxicity.non_negative_pu(xp, xu, 0.1)
    p = 1 / (1 + np.exp(-(xu @ w + base)))
    assert p[:40].mean() > 0.7 and p[40:].mean() < 0.1
