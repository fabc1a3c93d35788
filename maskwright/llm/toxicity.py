"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import Written, held_out, lean, record_batch, slices, texts_of

#: At most so many confirmed toxic texts are learnt from, and so many unlabelled ones begin the fit: those of least hash.
MOST_POSITIVE, FIRST_UNLABELLED = 4_000, 12_000
#: Steps in which all unlabelled texts then correct the weights.
STEPS = 8
#: Words and beginnings of words whose document frequencies among confirmed texts and in the corpus differ most.
VOCABULARY = 2_000
#: ... if by at least so many standard errors; below, chance alone brings up many.
LEAST_Z = 3.0
#: How much of a step is taken back where the corrected risk of negatives is below zero.
BACK = 0.1
#: Gradients are sent as whole multiples of this share, so that their sums don't depend on the order.
UNIT = 2.0**-30
CHUNK = 4 << 20
MEMORY = 300_000
_EDGES = ".,;:!?\"'()[]{}*#$%&|<>-_`~/\\…«»“”„’‘"


def words(text: str) -> set[str]:
    """The different words, in lower case, without the marks around them."""
    return {w.strip(_EDGES) for w in set(text.lower().split())}


def features_of(word: str) -> list[str]:
    """A word and, marked, its beginnings, as insults have endings."""
    return [word, *(f"^{word[:k]}" for k in range(3, min(9, len(word))))] if word else []


@dataclass
class Linear:
    """Weights of features, of which a text has each once or not."""

    weights: dict[str, float]
    base: float

    def scorer(self):
        """A function of a text."""
        find, weight = finder(list(self.weights)), list(self.weights.values())

        def score(text: str) -> float:
            z = self.base + sum(weight[i] for i in sorted(find(text)))
            return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))

        return score


def finder(names: list[str]):
    """A function of a text: the places in names of the features that it has. It remembers the features of so many words."""
    index = {f: i for i, f in enumerate(names)}
    known: dict[str, tuple[int, ...]] = {}

    def of_words(some: set[str]) -> set[int]:
        found: set[int] = set()
        for w in some:
            at = known.get(w)
            if at is None:
                if len(known) > MEMORY:
                    known.clear()
                at = known[w] = tuple(i for f in features_of(w) if (i := index.get(f)) is not None)
            if at:
                found.update(at)
        return found

    def find(text: str) -> set[int]:
        return of_words(words(text))

    find.of_words = of_words
    return find


def non_negative_pu(xp: np.ndarray, xu: np.ndarray, prior: float, rounds: int = 300, rate: float = 0.05, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and base that minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) for the logistic loss, by Adam.

    Where the corrected risk of negatives is below zero, the step goes up its gradient instead, as the estimator's authors
    propose, so that a flexible model can't drive it there. xp, xu: 0/1 matrices of confirmed and unlabelled texts.
    """
    w, base = np.zeros(xp.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        sp, su = (1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype) + base, -30, 30))) for x in (xp, xu))
        negative = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        dp, du = (sp - 1) * prior / len(xp), su / len(xu)
        dn = -prior * sp / len(xp)
        if negative >= 0:
            gp, gu = dp + dn, du
        else:
            gp, gu = -dn, -du
        grad = np.r_[gp.astype(xp.dtype) @ xp + gu.astype(xu.dtype) @ xu + l2 * w, gp.sum() + gu.sum()]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, base = w - step[:-1], base - step[-1]
    return w, base


def _confirmed_counts(batches):
    """How many texts of a batch have each feature."""
    schema = pa.schema([("feature", pa.string()), ("p", pa.int64())])
    for batch in batches:
        counts: Counter = Counter()
        for text in texts_of(batch):
            counts.update({f for w in words(text) for f in features_of(w)})
        if counts:
            yield record_batch(schema, list(counts), list(counts.values()))


def corpus_counts(docs: DataFrame, beginnings: list[str]) -> DataFrame:
    """docs (text) -> (feature, u): how many of all texts have each word, and each of these beginnings; the row of null counts the texts.

    A task adds its texts up, and sends what it has whenever it knows MEMORY words.
    """
    schema = pa.schema([("feature", pa.string()), ("u", pa.int64())])

    def given(counts, sums):
        rows = [*counts.items(), *((f, n) for f, n in zip(beginnings, sums.tolist(), strict=True) if n)]
        for at in range(0, len(rows), 50_000):
            yield record_batch(schema, *zip(*rows[at : at + 50_000], strict=True))

    def run(batches):
        find, counts, sums, texts = finder(beginnings), Counter(), np.zeros(len(beginnings), dtype=np.int64), 0
        for batch in batches:
            for text in texts_of(batch):
                own = words(text)
                counts.update(own)
                sums[list(find.of_words(own))] += 1
            texts += batch.num_rows
            if len(counts) > MEMORY:
                yield from given(counts, sums)
                counts, sums = Counter(), np.zeros(len(beginnings), dtype=np.int64)
        counts.pop("", None)
        yield from given(counts, sums)
        yield record_batch(schema, [None], [texts])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "feature string, u long").groupBy("feature").agg(F.sum("u").alias("u"))


def lookup(docs: DataFrame, names: list[str]) -> DataFrame:
    """(doc_id, at): the places in names of the features of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("at", pa.list_(pa.int32()))])

    def run(batches):
        find = finder(names)
        for batch in slices(batches, CHUNK):
            yield record_batch(schema, batch.column("doc_id"), [sorted(find(t)) for t in texts_of(batch)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, at array<int>")


def unlabelled_sums(lists: DataFrame, w: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Over all rows of lists (at): sums of the score's gradient, of a bound on its curvature, for each weight and then the base; and of the risk as negatives."""
    schema = pa.schema([("at", pa.int32()), ("g", pa.int64()), ("h", pa.int64())])
    size = len(w) + 1

    def run(batches):
        g, h, risk = np.zeros(size), np.zeros(size), 0.0
        for batch in batches:
            column = batch.column("at")
            flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy()
            lengths, first = np.diff(ends), ends[:-1] - ends[0]
            sums = np.concatenate([[0.0], np.cumsum(w[flat])])
            score = 1 / (1 + np.exp(-np.clip(base + sums[first + lengths] - sums[first], -30, 30)))
            curve = score * (1 - score) * (lengths + 1)
            g += np.r_[np.bincount(flat, weights=np.repeat(score, lengths), minlength=size - 1), score.sum()]
            h += np.r_[np.bincount(flat, weights=np.repeat(curve, lengths), minlength=size - 1), curve.sum()]
            risk -= np.log1p(-np.minimum(score, 1 - 1e-12)).sum()
        whole = lambda x: np.rint(np.asarray(x) / UNIT).astype(np.int64)
        some = np.flatnonzero(g)
        yield record_batch(schema, np.r_[some, -1].astype(np.int32), np.r_[whole(g[some]), whole([risk])], np.r_[whole(h[some]), 0])

    g, h, risk = np.zeros(size), np.zeros(size), 0.0
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    for r in lists.select("at").mapInArrow(lean(run), "at int, g long, h long").groupBy("at").agg(wide("g"), wide("h")).collect():  # a row for each weight
        if r["at"] < 0:
            risk = float(r["g"]) * UNIT
        else:
            g[r["at"]], h[r["at"]] = float(r["g"]) * UNIT, float(r["h"]) * UNIT
    return g, h, risk


def corrected(w: np.ndarray, base: float, xp: np.ndarray, lists: DataFrame, n: int, prior: float, steps: int = STEPS, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """The same risk as in non_negative_pu, over all n unlabelled texts: steps down its gradient, scaled by a bound on its curvature."""
    theta, xp = np.r_[w, base], np.c_[xp.astype(np.float64), np.ones(len(xp))]
    width = xp.sum(axis=1)
    for _ in range(steps):
        g, h, risk = unlabelled_sums(lists, theta[:-1], float(theta[-1]))
        sp = 1 / (1 + np.exp(-np.clip(xp @ theta, -30, 30)))
        negative = risk / n + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        gp, gn = (prior * (sp - 1) / len(xp)) @ xp, g / n - (prior * sp / len(xp)) @ xp
        curve = (prior * sp * (1 - sp) * width / len(xp)) @ xp + h / n + l2
        grad = (gp + gn if negative >= 0 else -BACK * gn) + l2 * np.r_[theta[:-1], 0]
        theta = theta - np.clip(grad / curve, -1, 1)
    return theta[:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, most_positive: int = MOST_POSITIVE, vocabulary: int = VOCABULARY, first_unlabelled: int = FIRST_UNLABELLED) -> Linear:
    """Learns from confirmed toxic texts, most_positive at most, and all texts that aren't held out, which count as unlabelled.

    The features that count are those whose document frequency among the confirmed texts is furthest from that in the
    corpus, which is counted over all texts: every word, and the beginnings of words of confirmed texts. The fit begins
    on first_unlabelled texts, one for each of as many ids; then steps over all of them correct it. The driver gets the
    chosen features and, for each step, their sums, and rows of the two samples over them. prior: the share of toxic
    texts; None: that among the labelled rows that aren't held out.
    """
    written = Written(docs.sparkSession)
    usable = labels.where(~held_out() & F.col("toxic").isNotNull())
    toxic = usable.where("toxic = 1").select(F.col("doc_id").cast("long")).distinct()
    if prior is None:
        prior = usable.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    prior = float(np.clip(0.1 if prior is None else prior, 1e-3, 0.9))
    chosen = toxic.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_positive)
    open_docs = docs.where(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    confirmed = open_docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))  # at most most_positive ids
    confirmed = written.put(confirmed, "confirmed")
    n_p = confirmed.count()
    if not n_p:
        return Linear({}, float(np.log(prior / (1 - prior))))
    own = written.put(confirmed.mapInArrow(lean(_confirmed_counts), "feature string, p long").groupBy("feature").agg(F.sum("p").alias("p")), "own")
    beginnings = [r[0] for r in own.where(F.startswith("feature", F.lit("^")) & (F.col("p") >= 5)).select("feature").orderBy("feature").collect()]  # of at most most_positive texts
    counts = written.put(corpus_counts(open_docs, beginnings), "counts")
    n_u = counts.where("feature IS NULL").first()["u"]
    p, u = F.coalesce("p", F.lit(0)) / n_p, F.coalesce("u", F.lit(0)) / n_u
    # a two-sample statistic of the frequencies
    z = F.abs(p - u) / F.sqrt((p * (1 - p) + 0.5 / n_p) / n_p + (u * (1 - u) + 0.5 / n_u) / n_u)
    both = counts.where("feature IS NOT NULL").join(own, "feature", "left").where((F.coalesce("p", F.lit(0)) + F.col("u") >= 5) & (z >= LEAST_Z))
    names = [r[0] for r in both.orderBy(z.desc(), "feature").limit(vocabulary).select("feature").collect()]
    lists = written.put(lookup(open_docs, names), "lists")

    def matrix(rows):
        out = np.zeros((len(rows), len(names)), dtype=np.float32)
        for line, r in zip(out, rows, strict=True):
            line[r.at] = 1
        return out

    xp = matrix(lookup(confirmed, names).orderBy("doc_id").collect())
    ids = lists.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(first_unlabelled)
    xu = matrix(lists.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("at").alias("at")).orderBy("doc_id").collect())
    w, base = non_negative_pu(xp, xu, prior)
    del xu
    w, base = corrected(w, base, xp, lists, n_u, prior)
    for table in (confirmed, own, counts, lists):
        written.drop(table)
    return Linear(dict(zip(names, w.tolist(), strict=True)), float(base))


def classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, prior: float | None = None, most_positive: int = MOST_POSITIVE) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted.

    Labels come only from rows that aren't held out (crc32 of the id as text, modulo 5, is 0), and only the whole text is
    looked at. Null and empty texts score the base rate; repeated ids keep their rows; without a confirmed text every
    score is the prior; an empty table gives an empty one; other columns are ignored.
    """
    model = train(docs, labels, prior, most_positive)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        score = model.scorer()
        for batch in slices(batches, CHUNK):
            yield record_batch(schema, batch.column("doc_id"), [score(t) for t in texts_of(batch)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(lean(run), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
