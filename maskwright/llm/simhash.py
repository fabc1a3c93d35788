"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import Written, lean, record_batch, shuffle_width, slices, texts_of
from maskwright.llm.components import components
from maskwright.llm.itq import Tables, plan
from maskwright.llm.repeats import LAST_ID

SEED = 42
#: Texts are hashed in pieces of so many shingles, which bounds the memory of very long ones.
PIECE = 1 << 17
#: A table bucket with more fingerprints than this is searched by a second index over the other half.
HOT_BUCKET = 1000


def shingle_hashes(text: str, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the word n-grams, repeats included, in pieces; fewer words: of the whole sequence; none: nothing."""
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return
    joined = b" ".join(parts)
    if len(parts) <= words:
        yield np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
        return
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()
    digest, n = xxhash.xxh64_intdigest, len(parts) - words + 1
    for at in range(0, n, PIECE):
        to = min(n, at + PIECE)
        yield np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at:to], stops[at + words - 1 : to + words - 1])], dtype=np.uint64)


def fingerprint(text: str, words: int) -> int:
    """Bit i is 1 if it is 1 in over half the hashes; 0 for a text without words."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, words):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for at in range(0, len(bits), 128):  # 8-bit sums of 128 rows don't overflow
            ones += np.add.reduce(bits[at : at + 128], axis=0, dtype=np.uint8)
        total += len(h)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long: the 64 bits as a signed number) for every row; null texts count as empty."""
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in texts_of(batch)], dtype=np.uint64).view(np.int64)
            yield record_batch(schema, batch.column("id"), fps)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "id long, fp long")


def _half(fp, segment: int):
    return F.shiftrightunsigned(fp, 32) if segment else fp.bitwiseAND(F.lit((1 << 32) - 1))


def _ball(value, bits: int, upward: bool):
    """The value and those at one flipped bit; upward: only flips of 0 to 1, of which a pair at distance one has exactly one."""
    flips = F.transform(F.array(*[F.lit(1 << i) for i in range(bits)]), lambda f: value.bitwiseXOR(f))
    if upward:
        flips = F.filter(flips, lambda v: v > value)
    return F.concat(F.array(value), flips)


def _near(x: str, y: str):
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= 3


def links(fps: DataFrame, written: Written, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Pairs (a < b) of different fingerprints at 3 or fewer differing bits; fps: (fp), each once.

    Of two halves of 32 bits one differs in at most one bit. So the table holds both halves of each fingerprint, and
    each half's ball of radius one is looked up there; the join's condition verifies the complete distance. A bucket of
    over hot_bucket fingerprints isn't compared as it is: its members and visitors meet in a second index over the other
    half, whose quarters' balls of radius one must hit (at most 3 differences remain), so that they share 48 bits and at
    most 65,536 fingerprints meet under a key.
    """
    table = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), _half(F.col("fp"), s).alias("value")) for s in (0, 1)])).alias("k")).select("fp", "k.*")
    probes = fps.select(F.col("fp").alias("of"), F.explode(F.array(F.lit(0), F.lit(1))).alias("segment"))
    probes = probes.withColumn("half", F.when(F.col("segment") == 1, _half(F.col("of"), 1)).otherwise(_half(F.col("of"), 0)))
    probes = probes.select("of", "segment", "half", F.explode(_ball(F.col("half"), 32, True)).alias("value"))
    # equal halves: the pair would be met from both sides
    once = (F.col("half") != F.col("value")) | (F.col("of") < F.col("fp"))
    hot = written.put(table.groupBy("segment", "value").count().where(F.col("count") > hot_bucket).select("segment", "value", F.lit(True).alias("hot")), "hot")
    if hot.isEmpty():
        found = probes.join(table, ["segment", "value"]).where(once & _near("of", "fp"))
    else:
        marked = table.join(hot, ["segment", "value"], "left")
        visits = probes.join(hot, ["segment", "value"], "left")
        cool = visits.where("hot is null").join(marked.where("hot is null").drop("hot"), ["segment", "value"]).where(once & _near("of", "fp"))
        other = lambda c: F.when(F.col("segment") == 1, _half(F.col(c), 0)).otherwise(_half(F.col(c), 1))
        quarter = lambda v, q: F.shiftrightunsigned(v, 16) if q else v.bitwiseAND(F.lit(65535))
        fine_table = marked.where("hot").withColumn("other", other("fp")).select("segment", "value", "fp", F.explode(F.array(*[F.struct(F.lit(q).alias("quarter"), quarter(F.col("other"), q).alias("part")) for q in (0, 1)])).alias("k")).select("segment", "value", "fp", "k.*")
        visited = lambda q: F.transform(_ball(quarter(F.col("other"), q), 16, False), lambda v: F.struct(F.lit(q).alias("quarter"), v.alias("part")))
        fine = visits.where("hot").withColumn("other", other("of"))
        fine = fine.select("of", "segment", "half", "value", F.explode(F.concat(*[visited(q) for q in (0, 1)])).alias("k")).select("of", "segment", "half", "value", "k.*")
        warm = fine.join(fine_table, ["segment", "value", "quarter", "part"]).where(once & _near("of", "fp"))
        found = cool.select("of", "fp").unionByName(warm.select("of", "fp"))
    return found.select(F.least("of", "fp").alias("a"), F.greatest("of", "fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable by links).

    Fingerprints link at 3 or fewer differing bits; equal ones are one node, so copies are never paired. Null and empty
    texts, and texts without words, have fingerprint zero and link like any other. Repeated ids keep one row each; rows
    with a null id link too and have their component; an empty table gives an empty table; other columns are ignored.
    """
    written = Written(docs.sparkSession)
    rows = written.put(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    found = written.put(links(nodes.select("fp"), written), "links")
    reached = components(found, written)
    # components are of fingerprints; the smallest document of each is what is asked for
    named = nodes.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    # written, so that the join has nothing but an exchange on either side, of which Spark splits a large component's part
    smallest = written.put(named.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    named = named.join(smallest, "component").select("fp", "component_id")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(named, "fp").select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")


# ---- groups of similar documents: wide fingerprints --------------------------------------------------------------------

#: 64-bit lanes of a wide fingerprint, at least: enough for distances to tell similarities.
LANES = 8
#: Weak bits of a segment that a probe flips: those whose votes were closest.
WEAK = 3
#: Standard deviations beyond the expected distance up to which pairs are tested; simulated pairs of 10 to 400 shingles, at just the similarity, stayed within 3.4.
SPARE = 4
#: Lanes by which those are told apart that a crowd's nearest pairs haven't linked: all their pairs are compared.
FINE_LANES = 32
#: Runs of up to so many rows under a key are compared pair by pair, side by side with all others.
SHORT_RUN = 12
#: A key with more rows than this is split into pairs of blocks of about this size.
MOST_UNDER_KEY = 50_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str, words: int) -> np.ndarray:
    """The different shingle hashes, ascending."""
    pieces = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(pieces)) if pieces else np.zeros(0, dtype=np.uint64)


def votes(shingles: np.ndarray, lanes: int) -> np.ndarray:
    """How many shingles set each of 64 * lanes bits: each lane rehashes the shingles' XXH64."""
    ones = np.zeros(64 * lanes, dtype=np.int64)
    for at in range(0, len(shingles), 128):
        h = shingles[at : at + 128, None] + np.arange(lanes, dtype=np.uint64) * _STEP
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return ones


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, copy, text): the id, null as the largest, and the text's hash tell rows apart that differ in either."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("copy", F.xxhash64("text"))


def _wide(rows: DataFrame, words: int, tables: Tables, lanes: int, seed: int) -> DataFrame:
    """(id, copy, class: a hash of the shingle set, c: the fingerprint's lanes, probes: for each table its own key, then those with a weak bit flipped)."""
    schema = pa.schema([("id", pa.int64()), ("copy", pa.int64()), ("class", pa.int64()), ("c", pa.list_(pa.int64())), ("probes", pa.list_(pa.int64()))])
    powers = 1 << np.arange(tables.bits, dtype=np.int64)
    own = np.arange(tables.count, dtype=np.int64) << tables.bits
    weak = min(WEAK, tables.bits)

    def run(batches):
        for batch in slices(batches, 4 << 20):
            names, codes, probes = [], [], []
            for text in texts_of(batch):
                shingles = shingle_set(text, words)
                names.append(xxhash.xxh64_intdigest(shingles.tobytes(), seed))
                margin = 2 * votes(shingles, lanes) - len(shingles)
                on = margin > 0
                codes.append(np.packbits(on, bitorder="little").view("<i8"))
                segments = on[: tables.count * tables.bits].reshape(tables.count, tables.bits)
                doubt = np.argsort(np.abs(margin[: tables.count * tables.bits]).reshape(tables.count, tables.bits), axis=1, kind="stable")[:, :weak]
                key = segments @ powers
                probes.append((own[:, None] + np.concatenate([key[:, None], key[:, None] ^ powers[doubt]], axis=1)).ravel())
            yield record_batch(schema, batch.column("id"), batch.column("copy"), np.array(names, dtype=np.uint64).view(np.int64), codes, probes)

    return rows.mapInArrow(lean(run), "id long, copy long, class long, c array<long>, probes array<long>")


def _apart(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int32)


def _nearest_first(ids: np.ndarray, codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of what is near, of the least distances (Prim): (a, b, the tree's first id)."""
    left, code = ids[1:].copy(), codes[1:].copy()
    dist, parent = np.full(len(left), np.iinfo(np.int32).max, dtype=np.int32), np.zeros(len(left), dtype=np.int64)
    at, here, root, n, found = ids[0], codes[0].copy(), ids[0], len(left), []
    while n:
        d = _apart(code[:n], here)
        better = d < dist[:n]
        dist[:n][better] = d[better]
        parent[:n][better] = at
        k = int(dist[:n].argmin())
        at, here = left[k], code[k].copy()
        if dist[k] <= most:
            found.append((parent[k], at, root))
        else:
            root = at
        n -= 1
        for x in (left, code, dist, parent):
            x[k] = x[n]
    return tuple(np.array(found, dtype=np.int64).reshape(-1, 3).T)


def _near_runs(key: np.ndarray, ids: np.ndarray, codes: np.ndarray, most: int, component: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, tree) among the rows of each key, which are sorted by key: pairs whose fingerprints are near.

    Without components: all pairs of a short run, whose tree is -1, and a forest of nearest pairs of a longer one, whose trees
    are named by a member (ids lose their last bit). With components: all pairs of different components, with their key for a tree.
    """
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    a, b, tree = [], [], []

    def add(x, y, of):
        a.append(np.minimum(x, y))
        b.append(np.maximum(x, y))
        tree.append(of)

    short = np.repeat(sizes <= SHORT_RUN, sizes)
    for d in range(1, min(SHORT_RUN, int(sizes.max()))):
        at = np.flatnonzero((key[d:] == key[:-d]) & short[d:])
        at = at[np.bitwise_count(codes[at] ^ codes[at + d]).sum(axis=1) <= most]
        if component is not None:
            at = at[component[at] != component[at + d]]
        add(ids[at], ids[at + d], np.full(len(at), -1) if component is None else key[at])
    for i in np.flatnonzero(sizes > SHORT_RUN):
        rows = np.arange(starts[i], starts[i] + sizes[i])
        rows = rows[np.unique(ids[rows], return_index=True)[1]]
        if component is None:
            x, y, root = _nearest_first(ids[rows], codes[rows], most)
            add(x, y, root & ((1 << 63) - 2))
            continue
        mine, own = codes[rows], component[rows]
        for k in range(len(rows) - 1):
            other = np.flatnonzero(own[k + 1 :] != own[k]) + k + 1
            other = rows[other[_apart(mine[other], mine[k]) <= most]]
            add(np.full(len(other), ids[rows[k]]), ids[other], np.full(len(other), key[starts[i]]))
    a, b, tree = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (a, b, tree))
    return a[a != b], b[a != b], tree[a != b]


def _first_meeting(key: np.ndarray, probes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Marks pairs of rows a, b whose key is the least that they have in common; probes: each row's keys, (rows, tables, keys in a table)."""
    out, last = np.empty(len(key), dtype=bool), np.iinfo(np.int64).max
    for at in range(0, len(key), 2_000):
        to = at + 2_000
        x, y = probes[a[at:to]][:, :, :, None], probes[b[at:to]][:, :, None, :]
        out[at:to] = np.where(x == y, x, last).min(axis=(1, 2, 3)) == key[at:to]
    return out


def _whole_parts(batches, enough: int):
    """Tables of about enough rows or more, in which no part of a key is cut; batches are sorted by key and part."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < enough:
            continue
        table = pa.Table.from_batches(held)
        key, part = table.column("key").to_numpy(), table.column("part").to_numpy()
        cut = int(np.count_nonzero((key != key[-1]) | (part != part[-1])))
        if not cut:
            continue
        yield table.slice(0, cut)
        held, size = table.slice(cut).to_batches(), size - cut
    if size:
        yield pa.Table.from_batches(held)


def _meetings(probes: DataFrame, most: int, tables: Tables) -> DataFrame:
    """Rows (a, b, tree) from rows (key, part, class, c, and in the second round component and probes), each once.

    A pair of the second round comes from the first of the keys under which it meets.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("tree", pa.int64())])
    grouped = "component" in probes.columns

    def settle(table: pa.Table):
        codes = table.column("c").combine_chunks()
        codes = codes.flatten().to_numpy().view(np.uint64).reshape(len(table), -1)  # bits of signed numbers would be counted without sign
        part = table.column("part").to_numpy().astype(np.int64)
        key = table.column("key").to_numpy()
        run = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
        ids = table.column("class").to_numpy()
        a, b, tree = _near_runs(run, ids, codes, most, table.column("component").to_numpy() if grouped else None)
        if grouped and len(a):
            names, row = np.unique(ids, return_index=True)
            probes = table.column("probes").combine_chunks().flatten().to_numpy().reshape(len(table), tables.count, -1)
            met = key[np.searchsorted(run, tree)]
            first = _first_meeting(met, probes, row[np.searchsorted(names, a)], row[np.searchsorted(names, b)])
            a, b, tree = a[first], b[first], np.full(int(first.sum()), -1)
        if len(a):
            yield record_batch(schema, a, b, tree)

    def run(batches):
        for table in _whole_parts(batches, 10_000 if grouped else 50_000):
            yield from settle(table)

    n = shuffle_width(probes.sparkSession)
    return probes.repartition(n, "key", "part").sortWithinPartitions("key", "part").mapInArrow(lean(run), "a long, b long, tree long").distinct()


def _probes(classes: DataFrame, written: Written) -> DataFrame:
    """(class, c, component if it is there, key, part): a row for each probe; a key with very many rows is dealt to pairs of blocks."""
    carried = [c for c in ("class", "c", "component") if c in classes.columns] + ["probes"] * ("component" in classes.columns)
    probes = classes.select(*carried, F.explode("probes").alias("key")).withColumn("part", F.lit(0))
    hot = classes.select(F.explode("probes").alias("key")).groupBy("key").count().where(F.col("count") > MOST_UNDER_KEY)
    hot = written.put(hot.select("key", F.ceil(F.col("count") / MOST_UNDER_KEY).cast("int").alias("blocks")), "hot")
    if hot.isEmpty():
        return probes
    mine = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    dealt = probes.drop("part").join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select(*carried, "key", (F.greatest("mine", "other") * F.col("blocks") + F.least("mine", "other")).alias("part"))


def _sets(rows: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(class, s: its different shingle hashes), from the text of the class's least row."""
    schema = pa.schema([("class", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches):
        for batch in slices(batches, 4 << 20):
            yield record_batch(schema, batch.column("class"), [shingle_set(t, words).view(np.int64) for t in texts_of(batch)])

    asked = classes.select("class", "least.id", "least.copy")
    # both sides grow with the input: never sent whole to every task
    found = rows.join(asked.hint("merge"), ["id", "copy"]).select("class", "text").dropDuplicates(["class"])
    return found.mapInArrow(lean(run), "class long, s array<long>")


def _most_apart(lanes: int, flip: float) -> int:
    return int(64 * lanes * flip + SPARE * np.sqrt(64 * lanes * flip * (1 - flip)))


def _fine(sets: DataFrame) -> DataFrame:
    """(class, c: a fingerprint of FINE_LANES lanes) from (class, s)."""
    schema = pa.schema([("class", pa.int64()), ("c", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            codes = []
            for s in batch.column("s"):
                s = s.values.to_numpy().view(np.uint64)
                codes.append(np.packbits(2 * votes(s, FINE_LANES) > len(s), bitorder="little").view("<i8"))
            yield record_batch(schema, batch.column("class"), codes)

    return sets.mapInArrow(lean(run), "class long, c array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose shingle sets have at least the given Jaccard index."""
    of = lambda c: sets.select(F.col("class").alias(c), F.col("s").alias(f"s{c}"), F.size("s").alias(f"n{c}"))
    sized = pairs.join(of("a"), "a").join(of("b"), "b").where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(similarity) - 1)
    common = sized.withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return common.where(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")) >= similarity).select("a", "b")


def _groups(docs: DataFrame, words: int, similarity: float, recall: float, id_col: str, text_col: str) -> DataFrame:
    """(id, copy, least: (id, copy) of the group's least row) per row; see similar_groups."""
    written = Written(docs.sparkSession)
    rows = _keyed(docs, id_col, text_col)
    flip = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    tables = plan(docs.count(), flip, recall, extra_bits=0)
    lanes = max(LANES, -(-tables.bits * tables.count // 64))
    most = _most_apart(lanes, flip)
    for seed in range(SEED, SEED + 100):
        wide = written.put(_wide(rows, words, tables, lanes, seed), "wide")
        classes = wide.groupBy("class").agg(F.min(F.struct("id", "copy")).alias("least"), F.min("c").alias("c"), F.max("c").alias("most_c"), F.min("probes").alias("probes"))
        classes = written.put(classes, "classes")
        if classes.where("c <> most_c").isEmpty():  # else two sets have the same hash: it is taken with another seed
            break
        written.drop(wide)
        written.drop(classes)
    classes = classes.drop("most_c")
    met = written.put(_meetings(_probes(classes, written), most, tables), "met")
    ends = lambda edges: edges.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    sets = written.put(_sets(rows, classes.join(ends(met), "class", "left_semi"), words), "sets")
    tested = met.select("a", "b").distinct()
    edges = written.put(_similar(tested, sets, similarity), "similar")
    reached = components(edges, written).withColumnRenamed("node", "class")
    # a forest whose pairs are all similar is one group; in others, what isn't in one group yet is compared pair by pair
    failed = met.where("tree >= 0").join(edges, ["a", "b"], "left_anti").select("tree").distinct()
    open_trees = written.put(failed, "open")
    if not open_trees.isEmpty():
        again = ends(met.join(open_trees, "tree", "left_semi"))
        again = _fine(sets.join(again, "class", "left_semi")).join(classes.select("class", "probes"), "class").join(reached, "class", "left")
        again = written.put(again.select("class", "c", "probes", F.coalesce("component", "class").alias("component")), "again")
        more = _meetings(_probes(again, written), _most_apart(FINE_LANES, flip), tables).select("a", "b")
        more = written.put(_similar(more.join(tested, ["a", "b"], "left_anti"), sets, similarity), "similar")
        reached = components(edges.unionByName(more), written).withColumnRenamed("node", "class")
    named = classes.select("class", "least").join(reached, "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = written.put(named.groupBy("component").agg(F.min("least").alias("least")), "smallest")  # for a join that Spark can split
    named = named.drop("least").join(smallest, "component").select("class", "least")
    return wide.select("id", "copy", "class").join(named, "class").select("id", "copy", "least")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) per row: documents linked by shingle sets of at least the given Jaccard index.

    Two shingle sets of Jaccard index s have a cosine of 2s/(1+s), and SimHash bits differ for a share of its angle over
    180 degrees. Fingerprints, of which each different shingle has one vote, only propose pairs: those that meet in a
    segment and differ in no more than that share for the given similarity plus SPARE standard deviations. What links them
    is the Jaccard index of the sets themselves. As telling similarities takes far more than a 64-bit fingerprint's few
    bits, fingerprints are wider: as many segments as the recall asks for a pair of just that similarity, each about as
    long as the logarithm of the number of documents. A segment's probes are its value and those with one of its least
    certain bits flipped.

    Equal shingle sets are one node, so copies are never paired. In a crowd under one key the nearest pairs that span it
    are tested first; only where some of them fail are all pairs compared that aren't in one group by then, by wider
    fingerprints yet, and those tested that aren't plainly apart. Documents
    without words are alike; fewer words than a shingle are one shingle; a null id counts as the largest; an empty table
    gives an empty one.
    """
    found = _groups(docs, words, similarity, recall, id_col, text_col)
    return found.select(F.col("id").alias("doc_id"), F.col("least.id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of similar rows the one of the smallest id, as it is; of those that share it, of the least text hash.

    Rows are told apart by id and text, so different texts under one id, or without any, each stay for their own group.
    Of rows that repeat both, one stays.
    """
    written = Written(docs.sparkSession)
    groups = written.put(_groups(docs, words, similarity, recall, id_col, text_col), "groups")
    kept = groups.where((F.col("id") == F.col("least.id")) & (F.col("copy") == F.col("least.copy"))).groupBy(F.col("id").alias("__id"), F.col("copy").alias("__copy")).count()
    kept = written.put(kept, "kept")
    # both sides grow with the input: never sent whole to every task
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    copy = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.withColumn("__id", key).withColumn("__copy", copy).join(kept.select("__id", "__copy").hint("merge"), ["__id", "__copy"], "left_semi")
    if not kept.where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["__id", "__copy"])
    return rows.drop("__id", "__copy")
