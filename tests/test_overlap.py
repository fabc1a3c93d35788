import random

from pyspark.sql import functions as F

from maskwright.operators import overlap


def test_against_all_pairs(spark):
    rng = random.Random(6)

    def spans(n):
        out = []
        for i in range(n):
            a = rng.choice([0, 0, 1, 7, 8, 255, 256, rng.randint(0, 500), rng.randint(0, 100_000)])
            out.append((rng.choice([1, 2, None]), rng.choice([0, 0, 1]), a, a + rng.choice([0, 1, 1, 2, 3, 4, 5, 8, 9, 64, 300, 70_000]), f"x{i}"))
        return out + [(1, 0, None, 5, "null"), (1, 0, 3, None, "null"), (1, 0, 9, 4, "backwards"), out[0], out[0]]

    one, other = spans(150), spans(200)
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, seq int, start int, end int, tag string").withColumns({"level": F.lit("l"), "bin": F.lit("b"), "a.b": F.lit(1)}).repartition(3)
    got = sorted((r.doc_id, r.seq, r.one.tag, r.other.tag, r.shared) for r in overlap.overlapping(df(one), df(other)).collect())
    whole = lambda rows: [r for r in rows if r[0] is not None and r[2] is not None and r[3] is not None and r[2] < r[3]]
    want = sorted((x[0], x[1], x[4], y[4], min(x[3], y[3]) - max(x[2], y[2])) for x in whole(one) for y in whole(other) if x[:2] == y[:2] and min(x[3], y[3]) > max(x[2], y[2]))
    assert got == want and len(want) > 300
    assert overlap.overlapping(df([]), df(other)).count() == 0


def test_a_long_text_is_spread(spark):
    """A million places of one text: an equi-join on bins, without a product, and each pair once."""
    tokens = spark.range(200_000).select(F.lit(1).alias("doc_id"), F.lit(0).alias("seq"), (F.col("id") * 5).cast("int").alias("start"), (F.col("id") * 5 + 4).cast("int").alias("end"))
    pages = spark.range(1000).select(F.lit(1).alias("doc_id"), F.lit(0).alias("seq"), (F.col("id") * 1000).cast("int").alias("start"), (F.col("id") * 1000 + 1000).cast("int").alias("end"))
    pairs = overlap.overlapping(tokens, pages)
    assert pairs.count() == 200_000
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
