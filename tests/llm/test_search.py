import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from maskwright.llm import kdtree, partitions

AWKWARD = [(9001, None), (9002, [0.0] * 8), (9003, [float("nan")] * 8), (9004, [None] * 8), (9005, [1.0, float("inf")] + [0.0] * 6), (9006, [])]


def vectors(seed: int, n: int, dims: int, groups: int = 12) -> list[tuple]:
    """Loose groups, with a vector that many rows repeat."""
    rng = np.random.default_rng(seed)
    middle = 2 * rng.standard_normal((groups, dims))
    rows = [(i, (middle[i % groups] + rng.standard_normal(dims)).astype(np.float32).tolist()) for i in range(n)]
    return rows + [(n + i, rows[7][1]) for i in range(n // 3)]


def table(spark, rows):
    clash = {c: F.lit(1) for c in ("label", "id", "v", "h", "cell", "q", "rank", "ids", "cluster", "k")}
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns(clash)


def exact(rows, every, top):
    """{(query id, vector): [(distance, id), ...]} by comparing each query with every row."""
    fit = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for k, (q, x) in enumerate(fit):
        if q is not None and q % every == 0:
            far = [(float(np.sqrt(((y - x) ** 2).sum())), math.inf if i is None else i) for j, (i, y) in enumerate(fit) if j != k and len(y) == len(x)]
            out[q, tuple(x)] = sorted(far)[:top]
    return out


def by_query(found):
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.score, math.inf if r.vec_id is None else r.vec_id))
    return out


def test_neighbours_of_small_tables_are_exact(spark):
    rows = [*vectors(1, 300, 8), *AWKWARD, (None, vectors(1, 8, 8)[0][1]), (400, [1.0, 2.0]), (401, [1.5, 2.0]), (500, [3.0]), (9100, None)]
    rows.append(rows[20])
    want = {q: far for (q, _), far in exact(rows, 20, 10).items() if far}
    assert by_query(partitions.nearest(table(spark, rows), every=20).collect()) == want
    assert want[400][0] == (0.5, 401) and len(want[400]) == 1 and 500 not in want
    assert partitions.nearest(table(spark, AWKWARD)).count() == 0 and partitions.nearest(table(spark, [])).count() == 0
    two = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (3, [2.0, 0.0])]
    assert sorted((r.rank, r.vec_id) for r in partitions.nearest(table(spark, two)).collect()) == [(1, 0), (1, 3), (2, 0), (2, 0), (3, 0), (3, 3)]


def test_neighbours_by_parts_of_parts(spark):
    rows = vectors(2, 1500, 8)
    for sent in (0, 32):
        found = partitions.nearest(table(spark, rows), every=10, most_cell=60, most_parts=4, most_sent=sent).collect()
        got, want = by_query(found), {q: far for (q, _), far in exact(rows, 10, 10).items()}
        assert {len(x) for x in got.values()} == {10} and got.keys() == want.keys()
        far = {(r.query_id, r.vec_id): r.score for r in found}
        of = {i: np.array(v, dtype=np.float64) for i, v in rows}
        assert all(s == float(np.sqrt(((of[a] - of[b]) ** 2).sum())) and a != b for (a, b), s in far.items())
        assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_queries_whose_cells_hold_too_few_are_compared_with_all(spark):
    rows = vectors(3, 200, 8)
    want = {q: far for (q, _), far in exact(rows, 50, 150).items()}
    assert by_query(partitions.nearest(table(spark, rows), every=50, top=150, most_cell=20, recall=0.1).collect()) == want


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((100, 6)) + 12 * np.eye(6)[k] for k in range(4)])
    x = x[rng.permutation(400)]
    near = partitions.neighbours(x, 10)
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2) + np.diag(np.full(400, np.inf))
    assert all(set(near[i]) == set(np.argsort(far[i])[:10]) for i in range(400))
    part = partitions.balanced_parts(x, near, 4)
    assert sorted(np.bincount(part)) == [100] * 4 and (part[near] == part[:, None]).mean() > 0.99


def lloyd(rows, k, rounds, dims, scale=256, salt="2:"):
    """Plain loops over Python's integers."""
    kept = [(i, tuple(math.floor(scale * float(x)) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{salt}{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for n in set(of):
            mine = [v for (_, v), o in zip(kept, of, strict=True) if o == n]
            centroids[n] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    out = [(i, *near(v)[::-1]) for i, v in kept]
    total = {}
    for _, n, d in out:
        total[n] = total.get(n, 0) + d
    return [(i, n, d, total[n], sum(total.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, n, d in out]


def ordered(rows):
    return sorted((r[0] is None, r[0] or 0, *r[1:]) for r in map(tuple, rows))


def test_clusters_against_plain_loops(spark):
    rows = [*vectors(5, 260, 6, 5), *AWKWARD, (None, [0.5] * 6), (None, [0.5] * 6), (7000, [-0.0] * 6), (7001, [1.0] * 5)]
    rows += rows[:3]
    for k, rounds in ((9, 4), (400, 2), (1, 3)):
        assert ordered(kdtree.clustered(table(spark, rows).repartition(3), k, rounds, 6).collect()) == ordered(lloyd(rows, k, rounds, 6)), k
    large = [(i, [float(1 << 18) * x for x in v]) for i, v in enumerate(np.random.default_rng(1).uniform(-1.9, 1.9, (150, 6)).astype(np.float32).tolist())]
    beyond = [(900, [float(1 << 19)] * 6), (901, [3e38] * 6)]  # left out
    assert ordered(kdtree.clustered(table(spark, large + beyond), 7, 3, 6).collect()) == ordered(lloyd(large, 7, 3, 6))
    assert kdtree.clustered(table(spark, AWKWARD), dims=6).count() == 0 and kdtree.clustered(table(spark, [])).count() == 0
    assert len(kdtree.clustered(table(spark, [])).columns) == 6


def test_trees_drive_centroids_out_and_assign_whole_nodes():
    rng = np.random.default_rng(6)
    points = (rng.integers(-40, 40, (3000, 3)) + 1000 * rng.integers(0, 4, (3000, 1))).astype(np.int32)
    points[100:900] = points[5]
    tree = kdtree.build(np.arange(3000), np.ones(3000, dtype=bool), points)
    assert (tree.last - tree.first)[tree.kids[:, 0] < 0].sum() == 3000 and (tree.points == points[tree.ids]).all()
    centroids = np.array([[0, 0, 0], [1000, 1000, 1000], [2000, 2000, 2000], [3000, 3000, 3000], [3000, 3000, 3000], [2, 0, 0]])
    far = ((points[:, None].astype(np.int64) - centroids) ** 2).sum(axis=2)
    of, distance = kdtree.labels(tree, centroids)
    assert (of == far.argmin(axis=1)[tree.ids]).all() and (distance == far.min(axis=1)[tree.ids]).all()
    n, sums = kdtree.totals(tree, centroids)
    assert n.tolist() == np.bincount(of, minlength=6).tolist() and all((sums[k] == tree.points[of == k].sum(axis=0)).all() for k in range(6))
    whole, places, _ = kdtree.assigned(tree, centroids)
    assert sum(tree.last[node] - tree.first[node] for node, _ in whole) + len(places) == 3000 and len(whole) > 2
