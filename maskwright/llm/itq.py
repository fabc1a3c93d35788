"""Near-duplicate embeddings: iterative quantisation codes, multi-index Hamming tables, reranking by cosine."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import Written, lean, record_batch
from maskwright.llm.components import components

#: Rotations are learnt from at most so many vectors, those of least hash; all vectors are indexed.
MOST_TRAINING = 8_000
MOST_TABLES = 64
SEED = 42


@dataclass(frozen=True)
class Tables:
    """count tables over segments of bits bits each; per_word of them fit a 64-bit word of the code."""

    bits: int
    count: int

    @property
    def per_word(self) -> int:
        return 63 // self.bits

    @property
    def code_words(self) -> int:
        return -(-self.count // self.per_word)


def plan(n: int, flip: float, recall: float, extra_bits: int = 2) -> Tables:
    """Segments long enough that a bucket holds few of n vectors by chance, and as many tables as the recall asks for.

    flip: the share of bits in which the least alike pair that must be found differs; a table finds it if its segment
    differs in at most one bit.
    """
    bits = min(31, max(8, math.ceil(math.log2(max(n, 2))) + extra_bits))
    hit = (1 - flip) ** bits + bits * flip * (1 - flip) ** (bits - 1)
    return Tables(bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit))))


def flips_at(sample: np.ndarray, cosine: float) -> np.ndarray:
    """For each unit vector the share of bits in which it differs from one at just that cosine: their angle around the mean, over pi.

    Vectors that share a direction are near their mean, where the same distance is a larger angle.
    """
    if not len(sample):
        return np.array([math.acos(cosine) / math.pi])
    square = ((sample - sample.mean(axis=0)) ** 2).sum(axis=1)
    return np.arccos(np.clip(1 - (1 - cosine) / np.maximum(square, 1e-12), -1, 1)) / np.pi


def plan_measured(n: int, flips: np.ndarray, recall: float) -> Tables:
    """As plan(), with the recall as the mean over vectors of these flips.

    Where that takes over MOST_TABLES tables segments are shorter; one of a single bit brings all pairs together.
    """
    bits = plan(n, 0.1, recall).bits
    while True:
        miss = 1 - (1 - flips) ** bits - bits * flips * (1 - flips) ** (bits - 1)
        for count in range(1, MOST_TABLES + 1):
            if np.mean(miss**count) <= 1 - recall:
                return Tables(bits, count)
        bits -= 1


def learn(sample: np.ndarray, bits: int, seed: int = SEED, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to bits columns) by iterative quantisation: of centred vectors, rotations that bring each near its own signs.

    More bits than dimensions take several rotations, each from its own random start. Few or no vectors give random ones.
    """
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dims)
    x = sample - mean
    blocks = []
    for _ in range(-(-bits // dims)):
        r, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
        if len(x) > dims:
            for _ in range(rounds):
                u, _, v = np.linalg.svd(np.where(x @ r >= 0, 1.0, -1.0).T @ x)
                r = (u @ v).T
        blocks.append(r)
    return mean, np.concatenate(blocks, axis=1)[:, :bits]


def encode(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, tables: Tables) -> np.ndarray:
    """(n, count) segments of the binary codes."""
    on = ((x - mean) @ projection >= 0).reshape(len(x), tables.count, tables.bits)
    return on @ (1 << np.arange(tables.bits, dtype=np.int64))


def unit_vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Rows in double precision, scaled to length one and filled up with zeros to dims components."""
    ends = column.offsets.to_numpy()
    x = np.zeros((len(column), dims))
    x[np.arange(dims) < np.diff(ends)[:, None]] = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(v: str):
    """Whether a vector can link: neither null, empty nor zero, all components finite."""
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return F.coalesce(F.col(v).isNotNull() & finite & F.exists(v, lambda c: c != 0.0), F.lit(False))


def _code_columns(tables: Tables) -> list[str]:
    return [f"c{w}" for w in range(tables.code_words)]


def index(classes: DataFrame, tables: Tables, mean: np.ndarray, projection: np.ndarray) -> DataFrame:
    """(id, c0, c1, ...): the codes of the classes' vectors, their segments side by side in words."""
    names = _code_columns(tables)
    schema = pa.schema([("id", pa.int64()), *[(c, pa.int64()) for c in names]])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                segments = encode(unit_vectors(batch.column("v"), len(mean)), mean, projection, tables)
                words = [sum(segments[:, t] << (tables.bits * (t % tables.per_word)) for t in range(w * tables.per_word, min(tables.count, (w + 1) * tables.per_word))) for w in range(tables.code_words)]
                yield record_batch(schema, batch.column("id"), *words)

    return classes.select("id", "v").mapInArrow(lean(run), "id long, " + ", ".join(f"{c} long" for c in names))


def candidates(codes: DataFrame, tables: Tables, most_flips: int) -> DataFrame:
    """Pairs (a < b) that meet in a table, their segments differing in at most one bit there, and whose complete codes differ in at most most_flips bits.

    A pair that would meet in several tables comes from the first of them only, so that no pair has to be made twice.
    """
    names = _code_columns(tables)
    mask = (1 << tables.bits) - 1
    segment = lambda t: F.shiftrightunsigned(names[t // tables.per_word], tables.bits * (t % tables.per_word)).bitwiseAND(F.lit(mask))
    all_segments = F.posexplode(F.array(*[segment(t) for t in range(tables.count)])).alias("t", "key")
    members = codes.select("id", *names, all_segments)
    visitors = codes.select(F.col("id").alias("by"), *[F.col(c).alias(f"by_{c}") for c in names], all_segments)
    flips = F.array(*[F.lit(1 << i).cast("long") for i in range(tables.bits)])
    up = F.filter(F.transform(flips, lambda f: F.col("key").bitwiseXOR(f)), lambda v: v > F.col("key"))
    visitors = visitors.withColumn("own", F.col("key")).withColumn("key", F.explode(F.concat(F.array("key"), up)))
    apart = [F.col(c).bitwiseXOR(F.col(f"by_{c}")) for c in names]
    near = sum((F.bit_count(x) for x in apart[1:]), F.bit_count(apart[0])) <= most_flips
    # no earlier table brings them together
    earlier = F.lit(False)
    for t in range(tables.count - 1):
        there = F.shiftrightunsigned(apart[t // tables.per_word], tables.bits * (t % tables.per_word)).bitwiseAND(F.lit(mask))
        earlier = earlier | ((F.col("t") > t) & (F.bit_count(there) <= 1))
    once = (F.col("own") != F.col("key")) | (F.col("by") < F.col("id"))
    met = visitors.join(members, ["t", "key"]).where(once & near & ~earlier)
    return met.select(F.least("by", "id").alias("a"), F.greatest("by", "id").alias("b"))


def reranked(pairs: DataFrame, classes: DataFrame, cosine: float, dims: int) -> DataFrame:
    """The pairs of vectors of one length, dims at most, whose cosine, in double precision, is at least the given one."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                alike = (unit_vectors(batch.column("va"), dims) * unit_vectors(batch.column("vb"), dims)).sum(axis=1) >= cosine
                yield batch.select(["a", "b"]).filter(pa.array(alike)).cast(schema)

    with_a = pairs.join(classes.select(F.col("id").alias("a"), F.col("v").alias("va")), "a")
    with_both = with_a.join(classes.select(F.col("id").alias("b"), F.col("v").alias("vb")), "b").where(F.size("va") == F.size("vb"))
    return with_both.select("a", "b", "va", "vb").mapInArrow(lean(run), "a long, b long")


def linked(classes: DataFrame, dims: int, written: Written, cosine: float, recall: float, most_training: int) -> DataFrame:
    """Links (a, b) between vectors (id, v) of up to dims components; shorter ones are filled up with zeros, which changes no angle."""
    x = classes.orderBy(F.xxhash64("id"), "id").limit(most_training).select("v").toArrow().column("v").combine_chunks()
    x = unit_vectors(x, dims)
    flips = flips_at(x, cosine)
    tables = plan_measured(classes.count(), flips, recall)
    bits, flip = tables.bits * tables.count, float(flips.max())
    most_flips = math.ceil(bits * flip + 4 * math.sqrt(bits * flip * (1 - flip)))
    mean, projection = learn(x, bits)
    codes = written.put(index(classes, tables, mean, projection), "codes")
    return written.put(reranked(candidates(codes, tables, most_flips), classes, cosine, dims), "links")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.97, most_training: int = MOST_TRAINING, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: vec_id, n_links (others linked directly), component_id (smallest id reachable), kept (vec_id = component_id).

    Vectors that are null, empty or zero, or hold a null or non-finite component, link with nothing; vectors of different
    lengths don't link with each other. Equal vectors are one class, whose members link with each other and with all
    members of linked classes without being paired one by one. Rows that share an id are vectors of their own; a null id
    stays null and counts after all others; an empty table gives an empty one; other columns are ignored. Every vector is
    indexed; what the tables miss is planned by recall, for pairs exactly at the given cosine; closer ones are missed less.

    There is an index for the lengths up to each power of two: as many as that at most, however many lengths there are.
    """
    written = Written(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).withColumn("fit", usable("v"))
    alone = rows.where("not fit").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("least"))
    rows = rows.where("fit").withColumn("v", F.transform("v", lambda c: c + 0.0)).select("id", "v")
    # a class is named by its vector's hash, as a row's id need not be its own; another seed if two vectors have the same
    for seed in range(100):
        named = rows.withColumn("class", F.xxhash64("v", F.lit(seed)))
        classes = written.put(named.groupBy("class", "v").agg(F.min("id").alias("least"), F.count("*").alias("members")).withColumnRenamed("class", "id"), "classes")
        if classes.groupBy("id").count().where("count > 1").isEmpty():
            rows = named
            break
        written.drop(classes)
    power = F.ceil(F.log2(F.size("v"))).cast("int")
    powers = sorted(r[0] for r in classes.select(power).distinct().collect())  # 31 at most
    if not powers:
        return _result(alone)
    parts = [linked(classes.where(power == p), 1 << p, written, cosine, recall, most_training) for p in powers]
    links = parts[0]
    for more in parts[1:]:
        links = links.unionByName(more)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both.join(classes.select(F.col("id").alias("b"), "members"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("members").alias("around"))
    reached = components(links, written).withColumnRenamed("node", "id")
    known = classes.select("id", "least", "members").join(around, "id", "left").join(reached, "id", "left")
    known = known.select("id", "least", (F.col("members") - 1 + F.coalesce("around", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component"))
    smallest = written.put(known.groupBy("component").agg(F.min("least").alias("least")), "smallest")  # for a join that Spark can split
    known = known.drop("least").join(smallest, "component").select(F.col("id").alias("class"), "n_links", "least")
    return _result(rows.join(known, "class").select("id", "n_links", "least").unionByName(alone))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("vec_id"), "n_links", F.col("least").alias("component_id"), F.coalesce(F.col("id") == F.col("least"), F.lit(False)).alias("kept"))
