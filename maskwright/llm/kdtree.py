"""Centroid clustering by filtering candidates down kd-trees: Lloyd's rounds with exact integer results."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import Written, lean, record_batch

#: Vectors of one tree, and of a leaf at most (more only where all of them are equal).
BLOCK, LEAF = 4096, 32
#: Components below this fit double precision through all sums of products, those below MOST fit 64-bit integers.
EXACT, MOST = 1 << 21, 1 << 27
TREE = "ids binary, valid binary, points binary, first binary, last binary, kids binary, low binary, high binary, sums binary"


@dataclass(frozen=True)
class Tree:
    """Points in the order of the leaves; nodes from the root downwards, level by level.

    A node has the points from first to last (excluded), their box (low, high) and the sum of each component; kids are its
    two children, or -1.
    """

    ids: np.ndarray
    valid: np.ndarray
    points: np.ndarray
    first: np.ndarray
    last: np.ndarray
    kids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    def packed(self) -> list[bytes]:
        return [getattr(self, name.split()[0]).tobytes() for name in TREE.split(", ")]

    @staticmethod
    def unpacked(row: dict[str, bytes], dims: int) -> Tree:
        read = lambda name, kind, *shape: np.frombuffer(row[name], dtype=kind).reshape(-1, *shape)
        return Tree(
            read("ids", np.int64), read("valid", np.bool_), read("points", np.int32, dims), read("first", np.int32), read("last", np.int32), read("kids", np.int32, 2),
            read("low", np.int32, dims), read("high", np.int32, dims), read("sums", np.int64, dims),
        )


def build(ids: np.ndarray, valid: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Tree:
    """Halves at the median of the widest side, until a leaf is small or all its points are equal."""
    order = np.arange(len(points))
    nodes, kids = [(0, len(points))], []
    low, high, sums = [], [], []
    for first, last in nodes:  # grows while it is walked
        part = points[order[first:last]]
        low.append(part.min(axis=0))
        high.append(part.max(axis=0))
        sums.append(part.sum(axis=0, dtype=np.int64))
        width = high[-1].astype(np.int64) - low[-1]
        if last - first <= leaf or not width.any():
            kids.append((-1, -1))
            continue
        half = (last - first) // 2
        order[first:last] = order[first:last][np.argpartition(part[:, width.argmax()], half)]
        kids.append((len(nodes), len(nodes) + 1))
        nodes += [(first, first + half), (first + half, last)]
    ends = np.array(nodes, dtype=np.int32)
    return Tree(ids[order], valid[order], points[order], np.ascontiguousarray(ends[:, 0]), np.ascontiguousarray(ends[:, 1]), np.array(kids, dtype=np.int32), np.array(low, dtype=np.int32), np.array(high, dtype=np.int32), np.array(sums))


def _kind(tree: Tree, centroids: np.ndarray):
    """Double precision holds every integer that occurs, or else 64-bit integers do."""
    most = max(int(np.abs(tree.low[0].astype(np.int64)).max()), int(np.abs(tree.high[0].astype(np.int64)).max()), int(np.abs(centroids).max()))
    return np.float64 if most < EXACT else np.int64


def assigned(tree: Tree, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """(nodes that have one centroid as a whole: pairs of node and centroid; places of the other points, and their centroids).

    Down the tree, the candidate nearest to a box's middle drives out those that are farther from every point of the
    box, which its corner farthest in their direction tells. One left: the node is its. In leaves with several the
    distances decide, equal ones for the smaller number.
    """
    c = centroids.astype(kind := _kind(tree, centroids))
    square = (c * c).sum(axis=1)
    active, mask = np.array([0]), np.ones((1, len(c)), dtype=bool)
    whole: list[tuple[int, int]] = []
    places, chosen = [], []
    while len(active):
        low, high = tree.low[active].astype(kind), tree.high[active].astype(kind)
        middle = low + high  # twice the middle; any candidate may be tried, the nearest drives out most
        nearest = np.where(mask, square * 2 - middle @ (c * 2).T, np.inf if kind is np.float64 else np.iinfo(np.int64).max).argmin(axis=1)
        for s in np.unique(nearest):
            at = nearest == s
            w = c - c[s]
            ahead = square - square[s] - 2 * (high[at] @ np.maximum(w, 0).T + low[at] @ np.minimum(w, 0).T)  # least difference of squared distances in the box
            mask[at] &= ahead <= 0
        alone = mask.sum(axis=1) == 1
        whole += zip(active[alone].tolist(), mask[alone].argmax(axis=1).tolist(), strict=True)
        leaf = ~alone & (tree.kids[active, 0] < 0)
        if leaf.any():
            sizes = tree.last[active[leaf]] - tree.first[active[leaf]]
            place = np.concatenate([np.arange(a, b) for a, b in zip(tree.first[active[leaf]], tree.last[active[leaf]], strict=True)])
            p = tree.points[place].astype(kind)
            far = np.where(np.repeat(mask[leaf], sizes, axis=0), square - 2 * (p @ c.T), np.inf if kind is np.float64 else np.iinfo(np.int64).max)
            places.append(place)
            chosen.append(far.argmin(axis=1))
        inner = ~alone & ~leaf
        active, mask = tree.kids[active[inner]].reshape(-1), np.repeat(mask[inner], 2, axis=0)
    none = np.zeros(0, dtype=np.int64)
    return whole, np.concatenate([none, *places]), np.concatenate([none, *chosen])


def totals(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(points of each centroid, sums of their components)."""
    n, sums = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
    whole, places, chosen = assigned(tree, centroids)
    for node, k in whole:
        n[k] += tree.last[node] - tree.first[node]
        sums[k] += tree.sums[node]
    for k in np.unique(chosen):
        mine = places[chosen == k]
        n[k] += len(mine)
        sums[k] += tree.points[mine].sum(axis=0, dtype=np.int64)
    return n, sums


def labels(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, squared distance) of each point."""
    of = np.zeros(len(tree.points), dtype=np.int64)
    whole, places, chosen = assigned(tree, centroids)
    for node, k in whole:
        of[tree.first[node] : tree.last[node]] = k
    of[places] = chosen
    apart = tree.points.astype(np.int64) - centroids[of]
    return of, (apart * apart).sum(axis=1)


def _trees(batches: Iterator[pa.RecordBatch], dims: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    count = 0

    def made():
        ids, valid, points = (np.concatenate(x) for x in zip(*held, strict=True))
        return record_batch(schema, *[pa.array([x], pa.binary()) for x in build(ids, valid, points).packed()])

    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK // 4):
            part = batch.slice(at, BLOCK // 4)
            ids = part.column("id")
            held.append((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), part.column("v").flatten().to_numpy().reshape(-1, dims).astype(np.int32)))
            count += part.num_rows
            if count >= BLOCK:
                yield made()
                held, count = [], 0
    if count:
        yield made()


def trees(rows: DataFrame, dims: int) -> DataFrame:
    """rows (id long, v array of long) -> kd-trees, each over about BLOCK vectors as they lie in their partition."""
    schema = pa.schema([(name.split()[0], pa.binary()) for name in TREE.split(", ")])
    return rows.select("id", "v").mapInArrow(lean(lambda batches: _trees(batches, dims, schema)), TREE)


def _each(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[Tree]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Tree.unpacked({name: batch.column(name)[i].as_buffer() for name in batch.schema.names}, dims)


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: each the floor of its vectors' mean; one without vectors stays.

    A task adds its trees up, so that it sends a row for each centroid at most; the driver gets the sums of all.
    """
    k, dims = centroids.shape
    schema = pa.schema([("k", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches):
        n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64)
        for tree in _each(batches, dims):
            more, added = totals(tree, centroids)
            n += more
            sums += added
        some = np.flatnonzero(n)
        if len(some):
            yield record_batch(schema, some.astype(np.int32), n[some], list(sums[some]))

    parts = forest.mapInArrow(lean(run), "k int, n long, sums array<long>")
    wide = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    out = centroids.copy()
    for row in parts.groupBy("k").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *wide).collect():  # at most k rows
        out[row["k"]] = [int(row[f"s{i}"]) // int(row["n"]) for i in range(dims)]
    return out


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in centroid).encode()).hexdigest()


def scaled(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array of long) of the vectors that take part: floor(scale * component)."""
    v = F.col("v")
    fit = v.isNotNull() & (F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST / scale))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    return rows.where(F.coalesce(fit, F.lit(False))).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors of dims components take part, as integers floor(scale * x); those that are null, of another length, or hold a
    null or non-finite component don't, nor do such with a component of 2**27 or more after scaling, whose distances
    would not fit a long. The k vectors of least sha256 of salt and id are the first centroids; fewer vectors make fewer
    centroids. Rows that share an id are vectors of their own, among the first centroids in their components' order; a
    null id comes after all others there, and stays null. Equal distances go to the smaller number; equal first
    centroids leave all but the first of them empty, where they stay. An empty table gives an empty one; other columns
    are ignored.

    The trees are built once, inside the partitions as they are read, and written to the shared folder; a round is one
    pass over them that shuffles k rows of sums for each task at most.
    """
    spark = vectors.sparkSession
    written = Written(spark)
    rows = scaled(vectors, dims, scale, id_col, vector_col)
    key = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    first = rows.orderBy(key.asc_nulls_last(), F.col("id").asc_nulls_last(), "v").limit(k).collect()  # k rows
    names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], names)
    centroids = np.array([r["v"] for r in first], dtype=np.int64)
    forest = written.put(trees(rows, dims), "trees")
    for _ in range(rounds):
        centroids = moved(forest, centroids)
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches):
        for tree in _each(batches, dims):
            of, distance = labels(tree, centroids)
            yield record_batch(schema, pa.array(tree.ids, mask=~tree.valid), of.astype(np.int32), distance)

    done = written.put(forest.mapInArrow(lean(run), "vec_id long, cluster int, distance long"), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    known = spark.createDataFrame([(i, sums[i], sum(sums.values()), digest(centroids[i])) for i in sorted(sums)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(known), "cluster").select(*[c.split()[0] for c in names.split(", ")])


def sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> str:
    """DuckDB: the same, every distance written out."""
    far = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"vs AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{salt}' || vec_id), vec_id, v) - 1)::INT AS n, v AS c FROM vs ORDER BY n LIMIT {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, n, far FROM (SELECT vec_id, v, arg_min({{'n': n, 'far': far}}, {{'far': far, 'n': n}}) AS best FROM (SELECT vec_id, v, n, {far} AS far FROM vs, c{r}) GROUP BY vec_id, v) AS t(vec_id, v, best), LATERAL (SELECT best.n AS n, best.far AS far))")
        if r < rounds:
            mean = "list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i)"
            steps.append(f"m{r} AS (SELECT n, {mean} AS c FROM (SELECT n, i, sum(x) AS s, count(*)::HUGEINT AS m FROM (SELECT n, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY n, i) GROUP BY n)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT n, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (n))")
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, n AS cluster, far::BIGINT AS distance, (sum(far) OVER (PARTITION BY n))::BIGINT AS cluster_inertia, (sum(far) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} USING (n)"""
