from pyspark.sql import functions as F

from maskwright.operators import sketches


def test_kept_and_merged(spark, tmp_path):
    """Days that share values, a batch that comes twice, a hot group, and null values and keys."""
    rows = spark.range(60_000).select(
        (F.col("id") % 7).cast("int").alias("day"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 5 == 0, None).otherwise("cold").alias("lang"),
        F.when(F.col("id") % 11 > 0, F.col("id") % 20_011).alias("value"),
    )
    for day in (0, 1, 2, 3, 4, 5, 6, 3):
        sketches.add(sketches.sketched(rows.where(F.col("day") == day), ("day", "lang"), "value"), str(tmp_path / "kept"), day)
    exact = {r.lang: (r.n, r.d) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("value").alias("d")).collect()}
    once = {r.lang: (r.n, r.n_distinct) for r in sketches.estimated(sketches.sketched(rows, ("lang",), "value")).collect()}
    many = {r.lang: (r.n, r.n_distinct) for r in sketches.estimated(sketches.merged(sketches.kept(spark, str(tmp_path / "kept")), ("lang",))).collect()}
    assert set(exact) == set(once) == set(many) == {"hot", "cold", None} and exact["hot"][1] > 10_000
    for lang, (n, distinct) in exact.items():
        for found in (once[lang], many[lang]):
            assert found[0] == n and abs(found[1] - distinct) <= 4 * sketches.error() * distinct


def test_no_values(spark):
    rows = spark.createDataFrame([(1, None), (1, None)], "k int, v string")
    assert sketches.estimated(sketches.sketched(rows, ("k",), "v")).first()[:] == (1, 2, 0)
    assert sketches.merged(sketches.sketched(rows.limit(0), ("k",), "v"), ("k",)).count() == 0


def test_smaller_sketches(spark):
    rows = spark.range(50_000).withColumn("k", F.lit(1))
    found = sketches.estimated(sketches.sketched(rows, ("k",), "id", 8)).first().n_distinct
    assert abs(found - 50_000) <= 4 * sketches.error(8) * 50_000
