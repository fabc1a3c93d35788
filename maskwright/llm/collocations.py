"""Phrase collocations: frequent word sequences by pivot partitioning, scored by how they exceed their parts.

A phrase belongs to its rarest word, its pivot. Around each occurrence of a word goes a fragment: up to so many words on
both sides as are no rarer, without what lies beyond a rarer one, since a phrase across that belongs to another pivot.
Fragments are dealt by pivot, mined where they arrive, and only phrases that hold the pivot are given out, so no phrase
is counted twice or in two places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import Written, lean, record_batch, shuffle_width
from maskwright.llm.repeats import mix

#: How rare a word is, is told by a table of so many counts, whatever the number of words: those of one place are added
#: up. Rarity only has to be an order that all tasks share.
SLOTS = 1 << 22
#: Bytes of text that are cut up together, and words that a task remembers.
CHUNK, REMEMBER = 4 << 20, 1 << 20
#: Occurrences from which a word's fragments are dealt by its neighbour too.
HOT = 1 << 22
_PIECE_ENDS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_SPLIT = bytes(10 if c in _PIECE_ENDS else 32 if c in _BLANKS else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Ids(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _seed(lang: str, attempt: int) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), xxhash.xxh64_intdigest(str(attempt).encode(), 42))


def _by_lang(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[str, bytes]]:
    """(lang, bytes) of about chunk bytes: pieces end with a line feed, words are parted by spaces; A-Z are lowered."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            data = bytes(text.as_buffer()).translate(_SPLIT) if text.is_valid else b""
            while len(data) > chunk:  # a very long text, in whole pieces
                end = data.rfind(b"\n", 0, chunk) + 1 or data.find(b"\n") + 1 or len(data)
                yield lang, data[:end]
                data = data[end:]
            if data:
                held.setdefault(lang, []).append(data)
                sizes[lang] = sizes.get(lang, 0) + len(data)
                if sizes[lang] >= chunk:
                    yield lang, b"\n".join(held.pop(lang))
                    del sizes[lang]
        if len(sizes) > 64:  # many languages, little of each
            for lang in list(held):
                yield lang, b"\n".join(held.pop(lang))
            sizes = {}
    for lang, texts in held.items():
        yield lang, b"\n".join(texts)


def words(docs: DataFrame) -> DataFrame:
    """docs (lang, text) -> (lang, word, f): how often each word occurs. A task sends each of its words once, or now and then."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])

    def run(batches):
        from collections import Counter

        counts: dict[str, Counter] = {}
        for lang, data in _by_lang(batches, CHUNK):
            own = counts.setdefault(lang, Counter())
            own.update(data.split())
            if sum(map(len, counts.values())) > REMEMBER:
                yield from given(counts)
                counts = {}
        yield from given(counts)

    def given(counts):
        for lang, own in counts.items():
            names, n = list(own), list(own.values())
            for at in range(0, len(names), 50_000):
                part = names[at : at + 50_000]
                yield record_batch(schema, [lang] * len(part), pa.array(part, pa.binary()).cast(pa.string()), n[at : at + 50_000])

    return docs.mapInArrow(lean(run), "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def rarity(known: DataFrame, least: int) -> np.ndarray:
    """Counts by place: known (h long, f) are words, of which those rarer than least don't count by themselves."""
    at = F.pmod(F.col("h"), F.lit(SLOTS)).cast("int")
    found = known.groupBy(at.alias("at")).agg(F.least(F.sum("f"), F.lit((1 << 32) - 1)).alias("f")).where(F.col("f") >= least).toPandas()  # SLOTS rows at most
    table = np.zeros(SLOTS, dtype=np.uint32)
    table[found["at"].to_numpy(dtype=np.int64)] = found["f"].to_numpy(dtype=np.int64)
    return table


def fragments_of(rank: np.ndarray, longest: int) -> np.ndarray:
    """(m, 2 * longest - 1) places in rank, or -1 for a blank: the fragment around each place, which is in the middle.

    rank: of each word in turn, higher for more frequent ones; below 0 it is none that counts, or a piece's end. Words
    before the pivot must be more frequent, so that of several equal pivots the first owns a phrase.
    """
    n, side = len(rank), longest - 1
    padded = np.full(n + 2 * side, -1, dtype=rank.dtype)
    padded[side : side + n] = rank
    here = np.flatnonzero(rank >= 0)
    own, out = rank[here], np.full((len(here), 2 * longest - 1), -1, dtype=np.int64)
    out[:, side] = here
    for step, is_in in ((-1, np.greater), (1, np.greater_equal)):
        on = np.ones(len(here), dtype=bool)
        for k in range(1, longest):
            on &= is_in(padded[here + side + step * k], own)
            out[on, side + step * k] = here[on] + step * k
    return out[(out[:, side - 1] >= 0) | (out[:, side + 1] >= 0)]


def _grouped(key: np.ndarray, rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by key (a hash of them), neighbours that are equal as one with their n added up; equal rows may stay apart only where hashes clash."""
    order = np.argsort(key, kind="stable")
    key, rows, n = key[order], rows[order], n[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return key[at], rows[at], np.add.reduceat(n, at) if len(at) else n


def _summed(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each different row once, with the sum of its n."""
    key = rows[:, 0]
    for i in range(1, rows.shape[1]):
        key = mix(key, rows[:, i])
    key, rows, n = _grouped(key, rows, n)
    if (key[1:] == key[:-1]).any():  # different rows of one hash
        order = np.lexsort(rows.T[::-1])
        rows, n = rows[order], n[order]
        at = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
        rows, n = rows[at], np.add.reduceat(n, at)
    return rows, n


def mined(fragments: np.ndarray, n: np.ndarray, right: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of 2 to longest words that hold the pivot, in the middle of each fragment (rows of word hashes, 0 for a blank).

    Of right fragments, those only that go on after the pivot. Phrases are filled up with 0.
    """
    side, rows, counts = longest - 1, [], []
    for size in range(2, longest + 1):
        for first in range(side - size + 1, side + 1):
            there = (fragments[:, first : first + size] != 0).all(axis=1)
            if first + size - 1 == side:
                there &= ~right
            phrase = np.zeros((int(there.sum()), longest), dtype=np.uint64)
            phrase[:, :size] = fragments[there, first : first + size]
            rows.append(phrase)
            counts.append(n[there])
    return _summed(np.concatenate(rows), np.concatenate(counts))


def _pack(*arrays: np.ndarray) -> list[bytes]:
    return [pa.compress(np.ascontiguousarray(a).tobytes(), codec="zstd", asbytes=True) for a in arrays]


def _unpack(data: bytes, size: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size * np.dtype(kind).itemsize, codec="zstd", asbytes=True), dtype=kind)


PARCEL = "bucket int, size int, known int, words binary, rows binary, counts binary, rights binary"


def routed(docs: DataFrame, table, least: int, longest: int, attempt: int, buckets: int, hot: int = HOT) -> DataFrame:
    """docs (lang, text) -> parcels of fragments, one for each bucket of pivots and chunk of text, equal fragments as one.

    table: the broadcast rarity(). Fragments of a pivot with hot occurrences and more go in two parts, each dealt by pivot
    and neighbour, so that no pivot has all of its fragments in one place.
    """
    names = [f.split()[0] for f in PARCEL.split(", ")]
    schema = pa.schema([(n, pa.int32() if i < 3 else pa.binary()) for i, n in enumerate(names)])
    side = longest - 1

    def run(batches):
        counts, ids, hashes = table.value, {}, {}
        for lang, data in _by_lang(batches, CHUNK):
            if lang not in ids or len(ids[lang]) > REMEMBER or len(ids) > 64:
                if lang not in ids and len(ids) > 64:
                    ids, hashes = {}, {}
                ids[lang], hashes[lang] = _Ids({b"": 0, b"\n": 1}), np.zeros(2, dtype=np.uint64)
            own = ids[lang]
            tokens = data.replace(b"\n", b" \n ").split(b" ")
            code = np.fromiter(map(own.__getitem__, tokens), dtype=np.int32, count=len(tokens))
            del tokens
            code = code[code != 0]
            if len(own) > len(hashes[lang]):
                from itertools import islice

                seed = _seed(lang, attempt)
                more = [xxhash.xxh64_intdigest(w, seed) for w in islice(own, len(hashes[lang]), None)]
                hashes[lang] = np.concatenate([hashes[lang], np.array(more, dtype=np.uint64)])
            h = hashes[lang]
            frequency = counts[(h % np.uint64(SLOTS)).astype(np.int64)].astype(np.int64)
            order = np.lexsort((h, frequency))
            rank = np.empty(len(h), dtype=np.int32)
            rank[order] = np.arange(len(h), dtype=np.int32)
            rank[frequency < least] = -1
            rank[:2] = -1
            place = fragments_of(rank[code], longest)
            if not len(place):
                continue
            rows = np.where(place >= 0, code[place], 0).astype(np.int32)  # 0 is no word's number
            del place
            right = np.zeros(len(rows), dtype=bool)
            pivot = h[rows[:, side]]
            deal = mix(pivot, pivot)
            split = frequency[rows[:, side]] >= hot
            if split.any():
                left, onward = split & (rows[:, side - 1] > 0), split & (rows[:, side + 1] > 0)
                a, b = rows[left], rows[onward]
                a[:, side + 1 :] = 0
                deal = np.concatenate([deal[~split], mix(h[a[:, side]], h[a[:, side - 1]]), mix(h[b[:, side + 1]], h[b[:, side]])])
                right = np.r_[right[~split], np.zeros(len(a), dtype=bool), np.ones(len(b), dtype=bool)]
                rows = np.concatenate([rows[~split], a, b])
            bucket = (deal >> np.uint64(33)) % np.uint64(buckets)
            key = right.astype(np.uint64)
            for i in range(rows.shape[1]):
                key = mix(key, h[rows[:, i]])
            wide = np.concatenate([rows, right[:, None].astype(np.int32)], axis=1)
            key, wide, n = _grouped((bucket << np.uint64(40)) | (key >> np.uint64(24)), wide, np.ones(len(wide), dtype=np.int64))
            bucket = key >> np.uint64(40)
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True):
                known, inverse = np.unique(wide[a:b, :-1], return_inverse=True)
                kind = np.uint16 if len(known) <= 1 << 16 else np.int32
                parts = _pack(np.where(known == 0, np.uint64(0), h[known]), inverse.reshape(b - a, -1).T.astype(kind), n[a:b], wide[a:b, -1].astype(np.uint8))
                yield record_batch(schema, [int(bucket[a])], [int(b - a)], [len(known)], *[pa.array([p], pa.binary()) for p in parts])

    return docs.mapInArrow(lean(run), PARCEL)


def counted(parcels: DataFrame, least: int, longest: int) -> DataFrame:
    """parcels, dealt and sorted by bucket -> (key array of word hashes, a) of the phrases that occur least times.

    A bucket is mined parcel by parcel; what it holds is each different phrase once.
    """
    schema = pa.schema([("key", pa.list_(pa.int64())), ("a", pa.int64())])

    def fragments(row):
        size, known = row["size"], row["known"]
        h = _unpack(row["words"], known, np.uint64)
        kind = np.uint16 if known <= 1 << 16 else np.int32
        rows = _unpack(row["rows"], size * (2 * longest - 1), kind).reshape(2 * longest - 1, size).T
        return h[rows], _unpack(row["counts"], size, np.int64), _unpack(row["rights"], size, np.uint8).astype(bool)

    def given(held):
        rows, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        rows, n = rows[n >= least], n[n >= least]
        lengths = (rows != 0).sum(axis=1)
        flat = rows.view(np.int64)[rows != 0]
        if len(n):
            yield record_batch(schema, pa.ListArray.from_arrays(np.r_[0, np.cumsum(lengths)].astype(np.int32), pa.array(flat)), n)

    def run(batches):
        bucket, held, waiting = None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if row["bucket"] != bucket:
                    if held:
                        yield from given(held)
                    bucket, held, waiting = row["bucket"], [], 0
                held.append(mined(*fragments(row), longest))
                waiting += len(held[-1][1])
                if waiting > 2_000_000 and len(held) > 1 and waiting > 2 * len(held[0][1]):
                    held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                    waiting = len(held[0][1])
        if held:
            yield from given(held)

    return parcels.mapInArrow(lean(run), "key array<long>, a long")


def _parts(phrases: DataFrame, longest: int) -> DataFrame:
    """(key, a, k, part 1, part 2) of each phrase, cut after its first k words."""
    cuts = F.filter(F.array(*[F.lit(k) for k in range(1, longest)]), lambda k: k < F.size("key"))
    rows = phrases.select("key", "a", F.explode(cuts).alias("k"))
    return rows.select("key", "a", "k", F.slice("key", F.lit(1), F.col("k")).alias("p1"), F.slice("key", F.col("k") + 1, F.size("key")).alias("p2"))


def scored(phrases: DataFrame, singles: DataFrame, longest: int) -> DataFrame:
    """(key, a, l, r, score) of the phrases: their lowest-scoring cut, the first of equals."""
    every = phrases.select("key", "a").unionByName(singles.select(F.array("h").alias("key"), F.col("f").alias("a")))
    cut = _parts(phrases, longest)
    cut = cut.join(every.select(F.col("key").alias("p1"), F.col("a").alias("l")), "p1").join(every.select(F.col("key").alias("p2"), F.col("a").alias("r")), "p2")
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.expr("(cast(a as decimal(16,0)) * cast(a as decimal(16,0)) * cast(1000000 as decimal(7,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cut.withColumn("cut", F.struct(score.alias("score"), "k", "l", "r")).groupBy("key", "a").agg(F.min("cut").alias("cut"))
    return best.select("key", "a", "cut.l", "cut.r", "cut.score")


def maximal(rows: DataFrame, phrases: DataFrame, longest: int, share: int) -> DataFrame:
    """rows (key, a, ...) that don't lie inside a longer phrase of share percent of their occurrences or more."""
    if longest == 2:
        return rows
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("key") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("key") - n + 1), lambda at: F.slice("key", at, n))))
    longer = phrases.where(F.size("key") > 2).select(F.explode(inner).alias("key"), "a").groupBy("key").agg(F.max("a").alias("longer"))
    return rows.join(longer, "key", "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share)).drop("longer")


def _first(rows: DataFrame, top: int, *order) -> DataFrame:
    """The first rows of each lang with rank: first those of each of many shares of it, then those of all shares together."""
    share = rows.withColumn("share", F.pmod(F.xxhash64("key"), F.lit(64)))
    some = share.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("share")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, share: int = 50, top: int = 2000, no_lang: str = "und", lang_col: str = "lang", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """Of each lang the first top phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    Words are runs of other characters than space and tab inside pieces, which end at any of . , ; : ! ? and line breaks;
    A-Z are lowered. A phrase is 2 to longest words that follow each other in a piece; a is how often it occurs, overlaps
    included, and phrases count from least on. Cut in two at its worst place, l and r are how often its parts occur, and
    score is floor(1000000 * a * a / (l * r)). A phrase inside a longer one that has share percent of its occurrences is
    left out. The order is by score, then a, both descending, then the phrase's bytes. n counts the lang's words.

    A null lang is no_lang, a null text is empty; texts without words, and tables without rows, add nothing; repeated rows
    count each time; other columns are ignored, whatever their names.

    All words are counted, and go through one shuffle after each task has added up its own; fragments of texts go through
    another, equal ones of a chunk as one; the rest works on frequent phrases only. Nothing but the table of rarity, whose
    size is fixed, is sent to all tasks. Words are told apart by a hash of 64 bits that is tried anew where two words of
    least occurrences share one.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more and occur once or more")
    spark = docs.sparkSession
    written = Written(spark)
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(no_lang)).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    vocabulary = written.put(words(rows), "words")
    for attempt in range(100):
        known = vocabulary.select("lang", "word", "f", F.xxhash64(F.lit(str(attempt)), "lang", "word").alias("h"))
        frequent = known.where(F.col("f") >= least)
        if frequent.where("h = 0").isEmpty() and frequent.groupBy("h").count().where("count > 1").isEmpty():
            break
    table = spark.sparkContext.broadcast(rarity(known, least))
    width = shuffle_width(spark)
    parcels = routed(rows, table, least, longest, attempt, 4 * width, hot).repartition(width, "bucket").sortWithinPartitions("bucket")
    phrases = written.put(counted(parcels, least, longest), "phrases")
    singles = written.put(frequent, "frequent")
    totals = vocabulary.groupBy("lang").agg(F.sum("f").alias("n"))
    kept = maximal(scored(phrases, singles, longest), phrases, longest, share)
    in_lang = written.put(kept.join(singles.select("lang", "h"), F.element_at("key", 1) == F.col("h")).drop("h"), "scored")
    # the least score and count of each lang that can be among the first: words are looked up for phrases from there on only
    order = F.desc("score"), F.desc("a")
    least_of = _first(in_lang.select("lang", "key", "score", "a"), top, *order).groupBy("lang").agg(F.min(F.struct("score", "a")).alias("least"))
    near = in_lang.join(least_of, "lang").where(F.struct("score", "a") >= F.col("least")).drop("least")
    spelt = near.select("lang", "key", F.posexplode("key").alias("at", "h")).join(singles.select("h", "word"), "h").groupBy("lang", "key").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("ws"))
    spelt = spelt.select("lang", "key", F.concat_ws(" ", "ws.word").alias("phrase"))
    first = _first(near.join(spelt, ["lang", "key"]), top, *order, "phrase")
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def sql(least: int = 10, share: int = 50, top: int = 2000) -> str:
    """DuckDB: the same for phrases of two and three words, every phrase counted by itself."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    listed AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS ws FROM pieces),
    f AS MATERIALIZED (SELECT lang, p, count(*) AS c FROM (SELECT lang, unnest(list_concat(
        list_transform(range(1, len(ws) + 1), lambda i: ws[i:i]), list_transform(range(1, len(ws)), lambda i: ws[i:i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2]))) AS p FROM listed) GROUP BY ALL),
    candidates AS (SELECT lang, p, c AS a FROM f WHERE len(p) > 1 AND c >= {least}),
    cuts AS (SELECT x.lang, x.p, a, k, fl.c AS l, fr.c AS r, ((1000000::HUGEINT * a * a) // (fl.c::HUGEINT * fr.c)) AS score
      FROM (SELECT *, unnest(range(1, len(p))) AS k FROM candidates) AS x JOIN f AS fl ON fl.lang = x.lang AND fl.p = x.p[1:x.k] JOIN f AS fr ON fr.lang = x.lang AND fr.p = x.p[x.k + 1:]),
    best AS (SELECT lang, p, any_value(a) AS a, arg_min({{'l': l, 'r': r, 'score': score}}, {{'score': score, 'k': k}}) AS b FROM cuts GROUP BY lang, p),
    longer AS (SELECT lang, q, max(a) AS m FROM (SELECT lang, unnest([p[1:2], p[2:3]]) AS q, a FROM candidates WHERE len(p) = 3) GROUP BY ALL),
    kept AS (SELECT best.lang, array_to_string(p, ' ') AS phrase, a, b.l AS l, b.r AS r, b.score::BIGINT AS score FROM best LEFT JOIN longer ON longer.lang = best.lang AND longer.q = best.p WHERE m IS NULL OR 100 * m < {share} * a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank::INT AS rank, phrase, a, l, r, n, score FROM ranked JOIN (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE len(p) = 1 GROUP BY lang) USING (lang) WHERE rank <= {top}"""
