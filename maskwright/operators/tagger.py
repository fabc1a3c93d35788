"""A name tagger learnt from expected findings: a structured perceptron over word features, decoded by Viterbi, many lines at once."""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.storage import Tables

#: Labels by type of expected finding; each begins with one tag and goes on with another.
LABELS = {"PERSON": "PERSON", "COMPANY": "ORG", "PHYSICAL_OR_MAILING_ADDRESS": "GPE"}
KINDS = tuple(LABELS.values())
TAGS = ("O", *[f"{edge}-{kind}" for kind in KINDS for edge in "BI"])
N = len(TAGS)
#: Rows of weights: features by hash, then each tag as the one before, then the beginning.
BUCKETS = 1 << 16
ROWS = BUCKETS + N + 1
#: Lines whose mistakes are put right together.
BLOCK = 32
_WORD = re.compile(r"\w+|[^\w\s]")
_NEVER = -1e9
_FORBIDDEN = np.array([[_NEVER if b.startswith("I") and a[1:] != b[1:] else 0.0 for b in TAGS] for a in (*TAGS, "O")])  # to go on, a name must have begun
_EDGE = np.uint64(0x5851F42D4C957F2D)


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD.finditer(text)]


def _shape(word: str) -> str:
    out = "".join("A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1+", out)


def _word_features(word: str) -> tuple[int, ...]:
    low = word.lower()
    return tuple(zlib.crc32(f.encode()) for f in (f"w{low}", f"s{_shape(word)}", f"p{low[:3]}", f"e{low[-3:]}"))


@dataclass(frozen=True)
class Lines:
    """Lines as arrays: feature rows of every word, one line after another, and each line's first word and length."""

    features: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    spans: list[list[tuple[int, int]]]

    def part(self, first: int, last: int) -> Lines:
        """The lines from first to before last."""
        starts, lengths = self.starts[first:last], self.lengths[first:last]
        begin = int(starts[0]) if len(starts) else 0
        return Lines(self.features[begin : begin + int(lengths.sum())], starts - begin, lengths, self.spans[first:last])


def encoded(texts: Sequence[str]) -> Lines:
    """Each word's own features, those of its neighbours, and pairs of shapes."""
    spans = [tokens(t) for t in texts]
    lengths = np.array([len(s) for s in spans], dtype=np.int64)
    number: dict[str, int] = {}
    code = np.array([number.setdefault(t[a:b], len(number)) for t, s in zip(texts, spans, strict=True) for a, b in s], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    if not len(code):
        return Lines(np.zeros((0, 11), dtype=np.int64), starts, lengths, spans)
    own = np.array([_word_features(w) for w in number], dtype=np.uint64)[code]
    before, after = np.full_like(own, _EDGE), np.full_like(own, _EDGE)
    before[1:], after[:-1] = own[:-1], own[1:]
    some = lengths > 0
    before[starts[some]], after[starts[some] + lengths[some] - 1] = _EDGE, _EDGE
    columns = [*own.T, before[:, 0], after[:, 0], before[:, 1], after[:, 1], before[:, 1] * np.uint64(31) + own[:, 1], own[:, 1] * np.uint64(37) + after[:, 1], np.ones(len(own), dtype=np.uint64)]
    mixed = np.stack([(c + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48) for k, c in enumerate(columns)], axis=1)
    return Lines(mixed.astype(np.int64) % BUCKETS, starts, lengths, spans)


def viterbi(lines: Lines, weights: np.ndarray) -> np.ndarray:
    """The best tag of every word: all lines step on together, the longest first."""
    emit = weights[lines.features].sum(axis=1)
    step = weights[BUCKETS : BUCKETS + N] + _FORBIDDEN[:N]
    order = np.argsort(-lines.lengths, kind="stable")
    starts, lengths = lines.starts[order], lines.lengths[order]
    alive = int((lengths > 0).sum())
    score = np.full((len(order), N), 0.0)
    score[:alive] = weights[ROWS - 1] + _FORBIDDEN[N] + emit[starts[:alive]]
    back = np.zeros((len(emit), N), dtype=np.int8)
    running = [alive]
    for t in range(1, int(lengths[0]) if alive else 0):
        m = int(np.searchsorted(-lengths, -t))  # lines longer than t
        paths = score[:m, :, None] + step
        best = paths.argmax(axis=1)
        back[starts[:m] + t] = best
        score[:m] = np.take_along_axis(paths, best[:, None], axis=1)[:, 0] + emit[starts[:m] + t]
        running.append(m)
    tags, now = np.zeros(len(emit), dtype=np.int64), score.argmax(axis=1)
    for t in range(len(running) - 1, -1, -1):
        m = running[t]
        place = starts[:m] + t
        tags[place] = now[:m]
        now[:m] = back[place, now[:m]]
    return tags


def found(lines: Lines, tags: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """(label, start, end) of the names in each line."""
    out = []
    for spans, first in zip(lines.spans, lines.starts.tolist(), strict=True):
        names: list[tuple[str, int, int]] = []
        for (a, b), tag in zip(spans, tags[first : first + len(spans)].tolist(), strict=True):
            if TAGS[tag][0] == "B":
                names.append((TAGS[tag][2:], a, b))
            elif TAGS[tag][0] == "I":
                names[-1] = (names[-1][0], names[-1][1], b)
        out.append(names)
    return out


def gold_tags(text: str, expected: Sequence[tuple[str, str]]) -> list[int]:
    """Tags of the text's words: those of expected (type, text) where they stand between word edges; of overlapping ones the longer."""
    spans, out = tokens(text), []
    taken: dict[int, int] = {}
    at = {a: i for i, (a, _) in enumerate(spans)}
    end = {b: i for i, (_, b) in enumerate(spans)}
    for kind, name in sorted({(k, n) for k, n in expected if k in LABELS and n}, key=lambda e: (-len(e[1]), e)):
        start = text.find(name)
        while start >= 0:
            first, last = at.get(start), end.get(start + len(name))
            start = text.find(name, start + len(name))
            if first is not None and last is not None and not any(i in taken for i in range(first, last + 1)):
                label = TAGS.index(f"B-{LABELS[kind]}")
                taken |= {i: label + (i > first) for i in range(first, last + 1)}
    out = [taken.get(i, 0) for i in range(len(spans))]
    return out


def _touched(lines: Lines, tags: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, tags) that a tagging counts, one pair for each of its weights and each copy of the word."""
    some = lines.lengths > 0
    first = np.zeros(len(tags), dtype=bool)
    first[lines.starts[some]] = True
    before = np.where(first, ROWS - 1, BUCKETS + np.r_[0, tags[:-1]])
    rows = np.repeat(np.concatenate([lines.features, before[:, None]], axis=1), copies, axis=0)
    return rows.ravel(), np.repeat(np.repeat(tags, copies), rows.shape[1])


def learnt_from(texts: Sequence[str], wanted: Sequence[Sequence[int]], weights: np.ndarray, copies: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(changes, sums of the changes after each block, blocks) of one pass over the lines; both are whole numbers.

    copies: how often each line stands there, one after another. What comes out is that of the lines written out; a line's
    copies are tagged once in a block, and not at all in the blocks of nothing else that follow one without a mistake.
    """
    change, late = np.zeros((ROWS, N), dtype=np.int64), np.zeros((ROWS, N), dtype=np.int64)
    now, blocks, every = weights.copy(), 0, encoded(texts)
    ends = np.cumsum(np.ones(len(texts), dtype=np.int64) if copies is None else np.asarray(copies, dtype=np.int64))
    at, last = 0, int(ends[-1]) if len(ends) else 0
    while at < last:
        stop = min(at + BLOCK, last)
        i, j = int(np.searchsorted(ends, at, side="right")), int(np.searchsorted(ends, stop)) + 1
        lines, right = every.part(i, j), np.array([t for w in wanted[i:j] for t in w], dtype=np.int64)
        tags = viterbi(lines, now)
        wrong = bool((tags != right).any())
        if wrong:
            here = np.repeat(np.diff(np.minimum(ends[i:j], stop), prepend=at), lines.lengths)
            for value, given in ((1, right), (-1, tags)):
                place = _touched(lines, given, here)
                np.add.at(now, place, value)
                np.add.at(change, place, value)
                np.add.at(late, place, value * blocks)
        same = 0 if wrong or j - i > 1 else (int(ends[i]) - stop) // BLOCK  # these blocks would change nothing either
        blocks += 1 + same
        at = stop + same * BLOCK
    return change, change * blocks - late, blocks


def train(gold: DataFrame, rounds: int = 5, shards: int = 8) -> NameTagger:
    """Learns from gold (doc_id, seq, text, entities: array of type, text), all of it; rows without expected names count too.

    In each round every shard learns by itself from the same weights; the mean of what they come to is where all begin the
    next round, and the mean over all steps is the model. A shard sends the weights that it has changed, at most ROWS of
    them, and the driver holds as many: nothing but the time grows with gold. Shards are by the rows' hash and read in
    order, and what they send are whole numbers, so the model is the same on any cluster. Equal rows travel as one with their
    number, so a line that is there very often is no burden to its shard. Null texts and null entities are empty; an empty
    table gives a tagger that finds nothing.
    """
    tables = Tables(gold.sparkSession)
    text, entities = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("entities"), F.array().cast("array<struct<type:string,text:string>>"))
    rows = gold.select(text, F.transform(entities, lambda e: F.struct(e["type"].alias("type"), e["text"].alias("text"))).alias("entities"))
    rows = rows.groupBy("text", "entities").agg(F.count("*").alias("n")).withColumn("hash", F.xxhash64("text")).withColumn("shard", F.pmod("hash", F.lit(shards)).cast("int"))
    rows = tables.put(rows.withColumn("told", F.to_json("entities")), "gold")
    n_pieces = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // (shards * 20_000)))
    # a shard's lines are learnt from in pieces, each from the same weights; so many partitions are asked for because lines
    # that are alike are so few bytes that Spark would put all pieces into one task
    pieces = rows.withColumn("piece", F.pmod(F.shiftright("hash", 20), F.lit(n_pieces))).repartition(shards * n_pieces, "shard", "piece")
    schema = pa.schema([("at", pa.int32()), ("blocks", pa.int64()), ("change", pa.list_(pa.int64())), ("total", pa.list_(pa.int64()))])

    def one_round(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        def learn(table: pa.Table) -> pa.Table:
            table = table.sort_by([("hash", "ascending"), ("text", "ascending"), ("told", "ascending")])
            texts = table.column("text").to_pylist()
            wanted = [gold_tags(t, [(e["type"], e["text"]) for e in es]) for t, es in zip(texts, table.column("entities").to_pylist(), strict=True)]
            change, total, blocks = learnt_from(texts, wanted, weights, table.column("n").to_numpy())
            at = np.flatnonzero(change.any(axis=1) | total.any(axis=1))
            at = np.r_[-1, at]  # the first row says how many blocks there were
            return pa.Table.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), blocks)), pa.array(list(change[at])), pa.array(list(total[at]))], schema=schema)

        sent = pieces.groupBy("shard", "piece").applyInArrow(learn, "at int, blocks long, change array<long>, total array<long>")
        sums = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("change", "total") for i in range(N)]
        change, total, blocks = np.zeros((ROWS, N)), np.zeros((ROWS, N)), 1
        for r in sent.groupBy("at").agg(F.sum("blocks").alias("blocks"), *sums).collect():  # ROWS and one at most
            if r["at"] < 0:
                blocks = max(1, r["blocks"])
            else:
                change[r["at"]], total[r["at"]] = ([r[f"{c}{i}"] for i in range(N)] for c in ("change", "total"))
        return change, total, blocks

    weights, mean = np.zeros((ROWS, N)), np.zeros((ROWS, N))
    for k in range(rounds):
        change, total, blocks = one_round(weights)
        mean += (weights + total / blocks - mean) / (k + 1)
        weights = weights + change / (shards * n_pieces)
    return NameTagger(mean.astype(np.float32))


@dataclass(frozen=True)
class NameTagger:
    """A provider of names for pipeline.Config: finds people, organisations and places as it has learnt to."""

    weights: np.ndarray

    def load(self):
        return lambda text: self.load_many()([text])[0]

    def load_many(self):
        weights = self.weights.astype(np.float64)

        def find(texts: Sequence[str]) -> list[list[tuple[str, int, int]]]:
            lines = encoded(texts)
            return found(lines, viterbi(lines, weights))

        return find

    def frame(self, spark: SparkSession) -> DataFrame:
        """(at, weights): the rows that aren't zero."""
        at = np.flatnonzero(self.weights.any(axis=1))
        return spark.createDataFrame(list(zip(at.tolist(), self.weights[at].astype(float).tolist(), strict=True)), "at int, weights array<float>")

    @staticmethod
    def of(frame: DataFrame) -> NameTagger:
        weights = np.zeros((ROWS, N), dtype=np.float32)
        for r in frame.select("at", "weights").collect():  # ROWS at most
            weights[r["at"]] = r["weights"]
        return NameTagger(weights)
