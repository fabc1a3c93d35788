"""Nearest neighbours by learned partitions: a balanced cut of a neighbour graph, and a small classifier that routes to its parts."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import Written, lean, record_batch
from maskwright.llm.itq import usable
from maskwright.llm.repeats import LAST_ID

#: A cell's router is learnt from at most so many of its vectors, those of least hash; all vectors are indexed.
MOST_TRAINING = 10_000
#: Vectors of a cell above which it is parted, parts of a cell at most, and how often cells of cells are parted.
MOST_CELL, MOST_PARTS, MOST_LEVELS = 2048, 64, 6
#: Routers that are sent to all tasks; more of them meet their cells' vectors in a shuffle.
MOST_SENT = 32
NEIGHBOURS, HIDDEN, EPOCHS, SEED = 10, 128, 30, 42
#: Vectors, and queries, that one task compares at once; vectors that meet their cell's router at once.
ROWS, QUERIES, ROUTED = 16_384, 1_024, 65_536
ROUTER = ("mean", "scale", "w1", "b1", "w2", "b2", "probes")


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """(n, k) nearest others of each vector."""
    k, square, out = min(k, len(x) - 1), (x * x).sum(axis=1), []
    for at in range(0, len(x), 512):
        far = square - 2 * (x[at : at + 512] @ x.T)
        far[np.arange(len(far)), np.arange(at, at + len(far))] = np.inf
        out.append(np.argpartition(far, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def _halved(x: np.ndarray, near: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Which vectors are in the second half, of equal size: few edges of near (places, -1 for none) lie across."""
    n = len(x)
    there, to = near >= 0, np.where(near >= 0, near, 0)
    a, b = np.repeat(np.arange(n), there.sum(axis=1)), to[there]
    degree = np.maximum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n), 1)
    around = lambda y: np.bincount(a, weights=y[b], minlength=n) + np.bincount(b, weights=y[a], minlength=n)
    centred = x - x.mean(axis=0)
    y = centred @ (centred.T @ (centred @ rng.standard_normal(x.shape[1])))  # near the widest direction
    for _ in range(40):  # towards the second eigenvector of the random walk
        y = y - (y * degree).sum() / degree.sum()
        y = (y + around(y) / degree) / 2
        y = y / max(np.abs(y).max(), 1e-300)
    side = np.zeros(n, dtype=bool)
    side[np.argsort(y, kind="stable")[n // 2 :]] = True
    swaps = max(1, n // 16)
    while swaps:  # pairs of vectors with most edges across change places, as long as that helps
        sign = np.where(side, 1.0, -1.0)
        gain = -sign * around(sign)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")[:swaps]], right[np.argsort(-gain[right], kind="stable")[:swaps]]
        good = gain[left] + gain[right] > 0
        tried = side.copy()
        tried[left[good]], tried[right[good]] = True, False
        if good.any() and (tried[a] != tried[b]).sum() < (side[a] != side[b]).sum():
            side = tried
        else:
            swaps //= 2
    return side


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, seed: int = SEED) -> np.ndarray:
    """The part of each vector, of equal sizes but for one; parts is a power of two."""
    rng, part = np.random.default_rng(seed), np.zeros(len(x), dtype=np.int64)
    size = 1
    while size < parts:
        for p in range(size):
            mine = np.flatnonzero(part == p)
            if len(mine) > 1:
                place = np.full(len(x), -1)
                place[mine] = np.arange(len(mine))
                part[mine[_halved(x[mine], place[near[mine]], rng)]] += size
        size *= 2
    return part


def logits(router: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    hidden = np.maximum((x - router["mean"]) / router["scale"] @ router["w1"] + router["b1"], 0)
    return hidden @ router["w2"] + router["b2"]


def fitted(x: np.ndarray, wanted: np.ndarray, seed: int = SEED) -> dict[str, np.ndarray]:
    """A classifier with one hidden layer, by stochastic gradients, for wanted shares of each part."""
    rng, dims, parts = np.random.default_rng(seed), x.shape[1], wanted.shape[1]
    router = {"mean": x.mean(axis=0), "scale": np.array(max(x.std(), 1e-300)), "w1": rng.standard_normal((dims, HIDDEN)) * np.sqrt(2 / dims), "b1": np.zeros(HIDDEN), "w2": rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), "b2": np.zeros(parts)}
    z, step = (x - router["mean"]) / router["scale"], 0
    first, second = ({n: np.zeros_like(router[n]) for n in ("w1", "b1", "w2", "b2")} for _ in range(2))
    for epoch in range(EPOCHS):
        rate = 0.003 * (1 - epoch / EPOCHS)
        order = rng.permutation(len(z))
        for at in range(0, len(z), 256):
            some = order[at : at + 256]
            hidden = np.maximum(z[some] @ router["w1"] + router["b1"], 0)
            out = hidden @ router["w2"] + router["b2"]
            p = np.exp(out - out.max(axis=1, keepdims=True))
            wrong = (p / p.sum(axis=1, keepdims=True) - wanted[some]) / len(some)
            back = (wrong @ router["w2"].T) * (hidden > 0)
            step += 1
            for n, g in (("w1", z[some].T @ back), ("b1", back.sum(axis=0)), ("w2", hidden.T @ wrong), ("b2", wrong.sum(axis=0))):
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.001 * (g * g - second[n])
                router[n] = router[n] - rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
    return router


def learnt(x: np.ndarray, parts: int, recall: float, seed: int = SEED) -> dict[str, np.ndarray]:
    """A router to parts, with probes: how many of its most probable parts hold that share of the neighbours of vectors it hasn't learnt from."""
    near = neighbours(x, NEIGHBOURS)
    part = balanced_parts(x, near, parts, seed)
    wanted = np.zeros((len(x), parts))
    for column in (part[:, None], part[near]):
        np.add.at(wanted, (np.repeat(np.arange(len(x)), column.shape[1]), column.ravel()), 1 / (1 + near.shape[1]))
    held = np.random.default_rng(seed).random(len(x)) < 0.1
    if held.all() or not held.any():
        held = np.arange(len(x)) % 10 == 0
    router = fitted(x[~held], wanted[~held], seed)
    scores = logits(router, x)
    home = scores.argmax(axis=1)
    ranks = (-scores[held]).argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
    found = np.take_along_axis(ranks, home[near[held]], axis=1).ravel()
    router["probes"] = np.array(1 + int(np.quantile(found, recall, method="higher")))
    return router


def packed(router: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **router)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as got:
        return {n: got[n] for n in ROUTER}


def _matrix(column) -> np.ndarray:
    """Vectors of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def routers(rows: DataFrame, large: DataFrame, most_cell: int, most_parts: int, most_training: int, recall: float) -> DataFrame:
    """(cell, size, router) of the large cells (cell, size), each learnt in one task from a bounded sample of the cell's vectors."""
    schema = pa.schema([("cell", pa.string()), ("size", pa.int64()), ("router", pa.binary())])

    def learn(table: pa.Table) -> pa.Table:
        x, size = _matrix(table.column("v")), table.column("size")[0].as_py()
        x = x[np.argsort(table.column("h").to_numpy(), kind="stable")[:most_training]]
        x = x[np.lexsort(x.T[::-1])]
        parts = 2
        while parts < most_parts and parts * most_cell < size and parts * 8 < len(x):
            parts *= 2
        return pa.Table.from_batches([record_batch(schema, [table.column("cell")[0].as_py()], [size], pa.array([packed(learnt(x, parts, recall))], pa.binary()))])

    some = rows.join(large, "cell").withColumn("h", F.xxhash64("cell", "v")).where(F.pmod("h", F.col("size")) < most_training)
    return some.select("cell", "size", "v", "h").groupBy("cell").applyInArrow(learn, "cell string, size long, router binary")


def _choices(router: dict[str, np.ndarray], x: np.ndarray, several: bool) -> np.ndarray:
    """The most probable part of each vector, or the router's number of them."""
    scores = logits(router, x)
    n = min(int(router["probes"]), scores.shape[1]) if several else 1
    return (-scores).argsort(axis=1, kind="stable")[:, :n]


def routed(rows: DataFrame, table: DataFrame, several: bool, most_sent: int = MOST_SENT) -> DataFrame:
    """rows (cell, v, ...), those of cells with a router in the cell's most probable part, or in several (a row for each)."""
    names = rows.columns
    found = table.select("cell", "router").limit(most_sent + 1).collect()
    sent = {r["cell"]: bytes(r["router"]) for r in found} if len(found) <= most_sent else None

    def moved(batch, router):
        parts = _choices(router, _matrix(batch.column("v")), several)
        out = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), parts.shape[1])))
        prefix = batch.column("cell")[0].as_py()
        return out.set_column(out.schema.get_field_index("cell"), "cell", pa.array([f"{prefix}/{p}" for p in parts.ravel().tolist()]))

    if sent is not None:

        def run(batches):
            known = {cell: unpacked(data) for cell, data in sent.items()}
            for batch in batches:
                cells = np.array(batch.column("cell").to_pylist(), dtype=object)
                for cell in sorted(set(cells.tolist())):
                    mine = batch.filter(pa.array(cells == cell))
                    yield moved(mine, known[cell]) if cell in known else mine

        return rows.mapInArrow(lean(run), rows.schema)

    def meet(vectors: pa.Table, own: pa.Table) -> pa.Table:
        vectors = vectors.select(names)
        return moved(vectors.combine_chunks(), unpacked(own.column("router")[0].as_py())) if vectors.num_rows and own.num_rows else vectors

    sizes = lambda: rows.groupBy("cell").agg(F.expr(f"(count(*) - 1) div {ROUTED} + 1").alias("shares"))
    met = table.select("cell", "router").join(sizes(), "cell").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).select("cell", "share", "router")
    dealt = rows.join(table.select("cell").join(sizes(), "cell"), "cell").withColumn("share", F.pmod(F.xxhash64("v"), "shares")).select(*names, "share")
    done = dealt.groupBy("cell", "share").cogroup(met.groupBy("cell", "share")).applyInArrow(meet, rows.schema)
    return done.unionByName(rows.join(table.select("cell"), "cell", "left_anti").select(names))


def compared(rows: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """(q, query_id, vec_id, score): the top nearest of each query (q, query_id, v, cell) in each of its cells' blocks of rows (ids, v, cell).

    Cells of many rows, and of many queries, are compared block by block.
    """
    schema = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    none = pa.Table.from_batches([], schema=schema)

    def near(mine: pa.Table, asked: pa.Table) -> pa.Table:
        if not mine.num_rows or not asked.num_rows:
            return none
        x, y, ids = _matrix(mine.column("v")), _matrix(asked.column("v")), mine.column("ids").to_pylist()
        square, most = (x * x).sum(axis=1), top + 1  # its own row may be among them
        out = []
        for q, own, v in zip(asked.column("q").to_pylist(), asked.column("query_id").to_pylist(), y, strict=True):
            far = square - 2 * (x @ v) + v @ v
            few = np.arange(len(x))
            if len(x) > most:  # this far none is left out by rounding
                edge = np.partition(far, most - 1)[most - 1]
                few = np.flatnonzero(far <= edge + 1e-11 * (square.max() + v @ v))
            score = np.sqrt(((x[few] - v) ** 2).sum(axis=1))
            found = sorted((s, i) for s, k in zip(score.tolist(), few.tolist(), strict=True) for i in ids[k])
            if (0.0, own) in found:
                found.remove((0.0, own))
            out += [(q, own, i, s) for s, i in found[:top]]
        return pa.Table.from_batches([record_batch(schema, *zip(*out, strict=True))]) if out else none

    count = lambda df, name, size: df.groupBy("cell").agg(F.expr(f"(count(*) - 1) div {size} + 1").alias(name))
    blocks = count(rows, "row_blocks", ROWS).join(count(queries, "query_blocks", QUERIES), "cell")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = rows.join(blocks, "cell").withColumn("a", F.pmod(F.xxhash64("v"), "row_blocks")).withColumn("b", each("query_blocks"))
    asked = queries.join(blocks, "cell").withColumn("b", F.pmod(F.xxhash64("q"), "query_blocks")).withColumn("a", each("row_blocks"))
    mine, asked = mine.select("cell", "a", "b", "ids", "v"), asked.select("cell", "a", "b", "q", "query_id", "v")
    return mine.groupBy("cell", "a", "b").cogroup(asked.groupBy("cell", "a", "b")).applyInArrow(near, "q long, query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = 100, top: int = 10, recall: float = 0.97, most_cell: int = MOST_CELL, most_parts: int = MOST_PARTS, most_training: int = MOST_TRAINING, most_sent: int = MOST_SENT, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query and rank (from 1): query_id, rank, vec_id, score, the Euclidean distance in double precision.

    Queries are the rows whose id is divisible by every, candidates all rows but the query's own; equal distances go to
    the smaller id. Vectors that are null, empty or zero, or hold a null or non-finite component, take no part; vectors
    of different lengths are searched apart. Rows that repeat an id, or all of a row, are candidates each; queries of one
    id have a list for each of their different vectors. A null id is a candidate after all others at its distance. An
    empty table, and one without queries, gives an empty one; other columns are ignored.

    Equal vectors are one, with the top + 1 least of their ids, more of which no list can hold. A cell of more than
    most_cell vectors is parted: a sample's neighbour graph is cut into parts of equal size, a classifier learns them,
    every vector goes to its most probable part and every query to so many as hold the share recall of the neighbours of
    sample vectors that were kept from it. Parts that are still too large are parted again. The vectors of a query's
    cells are then compared as they are. A query whose cells hold fewer than top others is compared with all vectors.
    """
    spark = vectors.sparkSession
    written = Written(spark)
    rows = vectors.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST_ID)).alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(usable("v"))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + 0.0)).withColumn("h", F.xxhash64("v"))
    whole = F.size("v").cast("string")
    least = rows.withColumn("nth", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("nth") <= top + 1)
    all_rows = written.put(least.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("v", "ids", whole.alias("cell")), "vectors")
    asked = rows.where((F.col("id") % every == 0) & (F.col("id") != LAST_ID)).select("id", "h", "v").distinct()
    all_queries = written.put(asked.select(F.monotonically_increasing_id().alias("q"), F.col("id").alias("query_id"), "v", whole.alias("cell")), "queries")
    rows, queries = all_rows, all_queries
    for _ in range(MOST_LEVELS):
        large = rows.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > most_cell)
        table = written.put(routers(rows, large, most_cell, most_parts, most_training, recall), "routers")
        if table.isEmpty():
            break
        rows, queries = written.put(routed(rows, table, False, most_sent), "rows"), written.put(routed(queries, table, True, most_sent), "asked")
    found = written.put(compared(rows, queries, top), "found")
    # cells with too few others: all vectors of the length
    counts = found.groupBy("q").agg(F.count("*").alias("n"))
    others = all_rows.groupBy("cell").agg(F.sum(F.size("ids")).alias("others"))
    short = all_queries.join(counts, "q", "left").join(others, "cell").where((F.coalesce("n", F.lit(0)) < top) & (F.coalesce("n", F.lit(0)) + 1 < F.col("others"))).select(*all_queries.columns)
    short = written.put(short, "short")
    if not short.isEmpty():
        found = found.join(short.select("q"), "q", "left_anti").unionByName(compared(all_rows, short, top))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != LAST_ID, F.col("vec_id")).alias("vec_id"), "score")
