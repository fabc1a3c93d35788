"""A quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import held_out, lean, record_batch, slices, texts_of
from maskwright.llm.textstats import NAMES, statistics

#: At most so many labelled rows are learnt from: those of least hash.
MOST_ROWS = 12_000
BINS = 64
CHUNK = 2 << 20
THRESHOLD = 0.3


@dataclass
class Forest:
    """Trees flattened into arrays: node i of a tree goes to left[i] if its feature is at most cut[i], else to left[i] + 1; a leaf points at itself."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """All rows and trees step down together."""
        trees = np.arange(len(self.feature))[None, :]
        rows = np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        for _ in range(self.depth):
            left = self.left[trees, at]
            right = (x[rows, self.feature[trees, at]] > self.cut[trees, at]) & (left != at)
            at = left + right
        return self.base + self.value[trees, at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for i in range(0, len(x), 2048):
            out[i : i + 2048] = 1 / (1 + np.exp(-self.margin(x[i : i + 2048])))
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, l2: float = 1.0, least: int = 10) -> Forest:
    """Second-order boosting of the log loss; splits are between quantile bins. One class only, or no rows, gives a constant."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base, size = float(np.log(share / (1 - share))), 2 ** (depth + 1) - 1
    feature, cut = np.zeros((trees, size), dtype=np.int64), np.zeros((trees, size))
    left, value = np.tile(np.arange(size), (trees, 1)), np.zeros((trees, size))
    forest = Forest(base, feature, cut, left, value, depth)
    if not len(y) or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    codes = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    features, margin = x.shape[1], np.full(len(y), base)
    flat = codes + np.arange(features) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        node, free = np.zeros(len(y), dtype=np.int64), 1
        level = [0]
        for d in range(depth + 1):
            below = []
            for i in level:
                rows = np.flatnonzero(node == i)
                g, h = grad[rows].sum(), hess[rows].sum()
                value[t, i] = -rate * g / (h + l2)
                if d == depth or len(rows) < 2 * least:
                    continue
                where = flat[rows].ravel()
                hist = [np.bincount(where, weights=w, minlength=features * BINS).reshape(features, BINS).cumsum(axis=1)[:, :-1] for w in (np.repeat(grad[rows], features), np.repeat(hess[rows], features), None)]
                gl, hl, nl = hist
                gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - g**2 / (h + l2)
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                f, b = divmod(int(gain.argmax()), BINS - 1)
                if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                    continue
                feature[t, i], cut[t, i], left[t, i] = f, edges[f][b], free
                node[rows] = free + (codes[rows, f] > b)
                below += [free, free + 1]
                free += 2
            level = below
        margin += value[t, node]
    return forest


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x: the statistics)."""
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])

    def run(batches):
        for batch in slices(batches, CHUNK):
            yield record_batch(schema, batch.column("doc_id"), [statistics(t) for t in texts_of(batch)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, x array<double>")


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Forest:
    """Learns from at most most_rows labelled rows that aren't held out, those of least hash; only their statistics come to the driver.

    Rows that share an id each count, and so does each label of an id, but the same label only once.
    """
    known = labels.where(~held_out(id_col) & F.col(label).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most_rows)
    wanted = known.select("doc_id").distinct()
    some = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(wanted), "doc_id", "left_semi")  # at most most_rows ids
    got = features(some).join(F.broadcast(known), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(most_rows).toPandas()
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(NAMES)))
    return boost(x, got["y"].to_numpy(dtype=np.float64))


def scored(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, score; with carry also rest (a struct of those columns) and text. One pass over the texts, nothing shuffled."""

    def run(batches):
        for batch in slices(batches, CHUNK):
            x = np.array([statistics(t) for t in texts_of(batch)]).reshape(-1, len(NAMES))
            columns = {"doc_id": batch.column("id"), "score": pa.array(forest.probability(x))}
            if carry:
                columns |= {"text": batch.column("text"), "rest": batch.column("rest")}
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*carry).alias("rest")] if carry else []))
    schema = "doc_id long, score double" + (f", text string, rest {dict(rows.dtypes)['rest']}" if carry else "")
    return rows.mapInArrow(lean(run), schema)


def classified(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most_rows: int = MOST_ROWS) -> DataFrame:
    """Per row of docs: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted.

    Labels come only from rows that aren't held out (crc32 of the id as text, modulo 5, is 0), and only the whole text is
    looked at. Null and empty texts are scored as texts without words; repeated ids keep their rows; without usable labels
    every score is the same; an empty table gives an empty one; other columns are ignored.
    """
    out = scored(docs, train(docs, labels, most_rows))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
